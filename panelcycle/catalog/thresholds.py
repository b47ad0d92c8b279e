"""Default rule thresholds and the quantiles that replace them once a series is long enough."""

from __future__ import annotations

# Defaults used when an entity has no calibrated threshold.
DEFAULT_THRESHOLDS: dict[str, float] = {
    "debt_late_cycle_low": 220.0,
    "debt_extreme": 280.0,
    "dsr_stretched": 17.0,
    "dsr_distress": 18.0,
    "dsr_extreme": 22.0,
    "cpi_elevated": 3.0,
    "cpi_peak": 4.0,
}

# Threshold -> (indicator, quantile, floor or None).
THRESHOLD_QUANTILES: dict[str, tuple[str, float, float | None]] = {
    "debt_late_cycle_low": ("total_credit_pct_gdp", 0.75, None),
    "debt_extreme": ("total_credit_pct_gdp", 0.95, None),
    "dsr_stretched": ("debt_service_ratio", 0.75, None),
    "dsr_distress": ("debt_service_ratio", 0.90, None),
    "dsr_extreme": ("debt_service_ratio", 0.95, None),
    "cpi_elevated": ("cpi_yoy", 0.75, 2.5),
    "cpi_peak": ("cpi_yoy", 0.90, 3.5),
}

# Fixed values.
CALIBRATION_QUANTILES: tuple[float, ...] = (0.50, 0.75, 0.90, 0.95)
MIN_OBSERVATIONS = 40
