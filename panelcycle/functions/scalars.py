"""Derived scalars, buckets and overlays as plain column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcycle.catalog import tilts as fixed


# Differences are NULL as soon as one side is.
DERIVED_FEATURES: dict[str, str] = {
    "cpi_change_3m": "cpi_yoy - cpi_yoy_3m_ago",
    "unemployment_change_3m": "unemployment_rate - unemployment_3m_ago",
    "policy_rate_change_6m": "policy_rate - policy_rate_6m_ago",
    "yield_curve_slope": "yield_10y - yield_2y",
    "total_credit_5y_change_pp": "total_credit_pct_gdp - total_credit_5y_ago",
    "dsr_5y_change_pp": "debt_service_ratio - debt_service_5y_ago",
    "real_rate_10y": "yield_10y - cpi_yoy",
}


def quadrant(growth: Column, inflation: Column, growth_trend: float | Column = 2.0,
             inflation_trend: float | Column = 2.0) -> Column:
    """Growth x inflation quadrant; on-trend and unknown values count as above trend."""
    growth_up = F.coalesce(growth >= growth_trend, F.lit(True))
    inflation_up = F.coalesce(inflation >= inflation_trend, F.lit(True))
    return (
        F.when(growth_up & inflation_up, fixed.GROWTH_UP_INFLATION_UP)
        .when(growth_up, fixed.GROWTH_UP_INFLATION_DOWN)
        .when(inflation_up, fixed.GROWTH_DOWN_INFLATION_UP)
        .otherwise(fixed.GROWTH_DOWN_INFLATION_DOWN)
    )


def direction(tilt: Column) -> Column:
    """Arrow bucket of a tilt."""
    # Bucket edges.
    strong, clear, slight = 1.5, 0.7, 0.2
    return (
        F.when(tilt >= strong, "↑↑↑").when(tilt >= clear, "↑↑").when(tilt >= slight, "↑")
        .when(tilt <= -strong, "↓↓↓").when(tilt <= -clear, "↓↓").when(tilt <= -slight, "↓")
        .otherwise("→")
    )


def lookup(table: Mapping, key: Column, default=None) -> Column:
    """Small constant mapping applied to a column."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def caution_level(phase: Column) -> Column:
    return lookup(fixed.CAUTION_BY_PHASE, phase.cast("int"), fixed.DEFAULT_CAUTION)


def real_yield_intensity(real_rate: Column) -> Column:
    """0 without a negative real rate, growing linearly to 1 at -1 % and below."""
    return F.when(real_rate <= -1, F.lit(1.0)).when(real_rate < 0, -real_rate).otherwise(F.lit(0.0))


def real_yield_regime(real_rate: Column) -> Column:
    return (
        F.when(real_rate.isNull(), "unknown")
        .when(real_rate < -1, "repression")
        .when(real_rate < 0, "mild repression")
        .when(real_rate < 1, "neutral")
        .otherwise("savers compensated")
    )


def home_currency_intensity(currency: Column, home_rate: Column, target_rate: Column) -> Column:
    """Half the real-rate gap, clamped to +-1; 0 for USD or when a rate is missing.

    The NULL test comes first because ``greatest``/``least`` skip NULLs.
    """
    half_gap = (home_rate - target_rate) / F.lit(2.0)
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half_gap))
    return F.when((currency != "USD") & half_gap.isNotNull(), clamped).otherwise(F.lit(0.0))


def status_band(metric: str, value: Column, bands=fixed.STATUS_BANDS) -> Column:
    """Label of the band a value falls in, built from the band table; NULL for NULL."""
    label: Column | None = None
    for name, low, high, text in bands:
        if name != metric:
            continue
        inside = value.isNotNull()
        if low is not None:
            closed_below = not any(
                n == metric and h == low and (n, t) in fixed.UPPER_CLOSED_BANDS for n, _, h, t in bands
            )
            inside = inside & (value >= low if closed_below else value > low)
        if high is not None:
            inside = inside & (value <= high if (metric, text) in fixed.UPPER_CLOSED_BANDS else value < high)
        label = F.when(inside, text) if label is None else label.when(inside, text)
    if label is None:
        raise ValueError(f"no bands for metric {metric!r}")
    return label
