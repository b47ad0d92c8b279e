"""Operators on whole series: growth rates, tails, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.functions.scalars import lookup
from panelcycle.operators.canonical import earliness, recency
from panelcycle.schema import PANEL, PanelColumns, present

# Rows back to the same period of the previous year.
ROWS_PER_YEAR: dict[str, int] = {"M": 12, "Q": 4, "A": 1}


def percent_change(value: Column, base: Column) -> Column:
    """Percent change with float semantics on a zero base: signed infinity, NULL for 0/0.

    ANSI division would fail the job on a zero base, so the zero base is a case of its own.
    """
    infinite = F.when(value > 0, F.lit(float("inf"))).when(value < 0, F.lit(float("-inf")))
    safe_base = F.when(base != 0, base)
    return F.when(base == 0, infinite).otherwise((value / safe_base - 1) * 100)


def year_over_year(
    rows: DataFrame,
    frequency: str | Column = "M",
    keys: Sequence[str] = tuple(PANEL.source_series_key),
    date: str = PANEL.date,
    value: str = PANEL.value,
) -> DataFrame:
    """Positional growth: against the row 12, 4 or 1 places back once missing values are gone.

    Every source's series grows by itself: places are counted among its own rows. A gap therefore moves the base. Rows without a base are dropped. ``frequency`` may be a
    column, in which case every series takes its own step; an unknown frequency is an error.
    """
    clean = rows.where(present(F.col(value)))
    in_order = Window.partitionBy(*keys).orderBy(date)
    if isinstance(frequency, str):
        if frequency not in ROWS_PER_YEAR:
            raise ValueError(f"no yearly step for frequency {frequency!r}, resample to M, Q or A first")
        base = F.lag(value, ROWS_PER_YEAR[frequency]).over(in_order)
        grown = clean.withColumn("_base", base)
    else:
        steps = {f: F.lag(value, n).over(in_order) for f, n in ROWS_PER_YEAR.items()}
        grown = clean.withColumns({f"_lag_{f}": c for f, c in steps.items()})
        chosen: Column = F.raise_error(F.concat(F.lit("no yearly step for frequency "), frequency)).cast("double")
        for f in ROWS_PER_YEAR:
            chosen = F.when(frequency == f, F.col(f"_lag_{f}")).otherwise(chosen)
        grown = grown.withColumn("_base", chosen).drop(*[f"_lag_{f}" for f in ROWS_PER_YEAR])
    growth = percent_change(F.col(value), F.col("_base"))
    return grown.withColumn(value, growth).drop("_base").where(F.col(value).isNotNull())


def year_over_year_calendar(
    rows: DataFrame,
    keys: Sequence[str] = tuple(PANEL.source_series_key),
    date: str = PANEL.date,
    value: str = PANEL.value,
) -> DataFrame:
    """Growth of every source's series against its row dated exactly twelve months earlier; a gap yields no row.

    The base is found in the same sorted window (a frame of one month index), so no self join.
    """
    clean = rows.where(present(F.col(value)))
    month = F.year(date) * 12 + F.month(date)
    yearly = Window.partitionBy(*keys, F.dayofmonth(date)).orderBy(month).rangeBetween(-12, -12)
    based = clean.withColumn("_base", F.first(value).over(yearly))
    growth = percent_change(F.col(value), F.col("_base"))
    return based.withColumn(value, growth).drop("_base").where(F.col(value).isNotNull())


def tail_rows(panel: DataFrame, n: int | Column, keys: Sequence[str] = tuple(PANEL.series_key),
              date: str = PANEL.date, source: str = PANEL.source, priority: Sequence[str] = ()) -> DataFrame:
    """The newest n rows of each series; within a day the best-ranked source comes first.

    With a constant n Spark applies the row limit inside every map task before the shuffle, so a
    very long series never travels whole. A panel without a source column is ordered by date alone.
    """
    order = recency(F.col(date), F.col(source), priority) if source in panel.columns else F.col(date)
    newest_first = Window.partitionBy(*keys).orderBy(order.desc())
    return panel.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= n).drop("_n")


def display_tails(panel: DataFrame, tails: dict[str, int], cols: PanelColumns = PANEL,
                  priority: Sequence[str] = ()) -> DataFrame:
    """Tail per indicator: 750 daily, 60 monthly, 40 or 80 quarterly rows, as the table says."""
    wanted = panel.where(F.col(cols.indicator).isin(list(tails)))
    longest = tail_rows(wanted, max(tails.values()), cols.series_key, cols.date, cols.source, priority)
    # the constant limit bounds the series first, the indicator's own limit then trims it
    own = lookup(tails, F.col(cols.indicator))
    return tail_rows(longest, own, cols.series_key, cols.date, cols.source, priority)


# Rows shown per indicator.
DISPLAY_TAILS: dict[str, int] = {
    "policy_rate": 750, "yield_10y": 750, "yield_2y": 750,
    "cpi_yoy": 60, "unemployment_rate": 60, "real_gdp_yoy": 40,
    "total_credit_pct_gdp": 80, "gov_debt_pct_gdp": 80, "debt_service_ratio": 80,
    "hh_debt_pct_gdp": 80, "corp_debt_pct_gdp": 80,
}


def series_summary(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Row count, first and last date per series."""
    return panel.groupBy(*cols.series_key).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.min(cols.date).alias("first_date"),
        F.max(cols.date).alias("last_date"),
    )


def series_change(panel: DataFrame, cols: PanelColumns = PANEL, priority: Sequence[str] = ()) -> DataFrame:
    """First and last value of each series, their change and the quarter of the last one.

    Several sources on the first or last day: the best-ranked one counts.
    """
    day, source = F.col(cols.date), F.col(cols.source)
    ends = panel.groupBy(*cols.series_key).agg(
        F.min(cols.date).alias("first_date"),
        F.max(cols.date).alias("last_date"),
        F.min_by(cols.value, earliness(day, source, priority)).alias("first_value"),
        F.max_by(cols.value, recency(day, source, priority)).alias("last_value"),
    )
    return ends.withColumns(
        {
            "change": F.col("last_value") - F.col("first_value"),
            "last_year": F.year("last_date"),
            "last_quarter": F.quarter("last_date"),
        }
    )


def history(panel: DataFrame, entity: str, indicator: str, cols: PanelColumns = PANEL) -> DataFrame:
    """One series in date order; both equalities and the two columns reach the scan."""
    return (
        panel.where((F.col(cols.entity) == entity) & (F.col(cols.indicator) == indicator))
        .select(cols.date, cols.value)
        .orderBy(cols.date)
    )
