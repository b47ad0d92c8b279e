"""Indicator lists of the two feature snapshots and their anchor-relative lags."""

from __future__ import annotations

# Fixed values.
SHORT_TERM_INDICATORS: tuple[str, ...] = (
    "real_gdp_yoy", "cpi_yoy", "unemployment_rate", "policy_rate", "yield_10y", "yield_2y",
)
LONG_TERM_INDICATORS: tuple[str, ...] = (
    "total_credit_pct_gdp", "gov_debt_pct_gdp", "private_nonfin_pct_gdp",
    "hh_debt_pct_gdp", "corp_debt_pct_gdp", "debt_service_ratio",
)
ALL_INDICATORS: tuple[str, ...] = SHORT_TERM_INDICATORS + LONG_TERM_INDICATORS
SIGNAL_INDICATOR = "hy_spread"
SIGNAL_WINDOW_DAYS = 365 * 20

# Lagged feature -> (indicator, days before the newest row found).
LAGGED_FEATURES: dict[str, tuple[str, int]] = {
    "cpi_yoy_3m_ago": ("cpi_yoy", 90),
    "unemployment_3m_ago": ("unemployment_rate", 90),
    "policy_rate_6m_ago": ("policy_rate", 180),
    "total_credit_5y_ago": ("total_credit_pct_gdp", 365 * 5),
    "debt_service_5y_ago": ("debt_service_ratio", 365 * 5),
}
