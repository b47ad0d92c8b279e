"""As-of lookups over a date grid, with anchor-relative lags.

The grid is known to the driver, so every observation can be given the first grid slot that
sees it. Keeping only the newest row per (series, slot) is an aggregate; the row then holds
from its slot until the next slot of the same series that has news. No observation is ever
paired with a grid date it does not answer, and nothing is sorted beyond a series' own days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.operators.canonical import canonical_panel, recency
from panelcycle.schema import PANEL, PanelColumns

def latest_at(panel: DataFrame, as_of: dt.date, priority: Sequence[str] = (), cols: PanelColumns = PANEL) -> DataFrame:
    """Newest row at or before one date per series: one scan, one combined aggregate.

    The date bound reaches the Parquet scan; both buffers are primitives, so this is a hash
    aggregate whose shuffle carries one row per series and map task.
    """
    seen = panel.where(F.col(cols.date) <= F.lit(as_of)).select(
        *cols.series_key, cols.date, cols.value,
        recency(F.col(cols.date), F.col(cols.source), priority).alias("_recency"),
    )
    return seen.groupBy(*cols.series_key).agg(
        F.max_by(cols.value, "_recency").alias("value"),
        F.max(cols.date).alias("observed_on"),
    )


def with_anchor_lags(canonical: DataFrame, lags: Sequence[int], cols: PanelColumns = PANEL) -> DataFrame:
    """Add ``lag_<n>d``: the series' value at or before (row date - n days), NULL if none.

    A lag hangs on the observation that was found, not on the grid date, so it is computed once
    per observation. All frames share one partitioning and one sort, and each only ever grows.
    """
    return canonical.select("*", *_anchor_lags(lags, cols))


def _by_day(cols: PanelColumns):
    return Window.partitionBy(*cols.series_key).orderBy(F.unix_date(F.col(cols.date)))


def _anchor_lags(lags: Sequence[int], cols: PanelColumns) -> list[Column]:
    series = _by_day(cols)
    return [F.last(cols.value).over(series.rangeBetween(Window.unboundedPreceding, -n)).alias(f"lag_{n}d") for n in lags]


def grid_calendar(df: DataFrame, grid: Sequence[dt.date]) -> DataFrame:
    """Calendar day -> slot, for the days after the first grid date up to the last one."""
    edges = df.sparkSession.createDataFrame(
        [(i, low, high) for i, (low, high) in enumerate(zip(grid, grid[1:]), start=1)],
        "slot int, low date, high date",
    )
    return edges.select(
        "slot",
        F.explode(F.sequence(F.date_add("low", 1), F.col("high"))).alias("_day"),
    )


def with_slot(df: DataFrame, date: Column, grid: Sequence[dt.date], name: str = "slot") -> DataFrame:
    """Add the index of the first grid date at or after ``date``; ``len(grid)`` if there is none.

    The calendar is broadcast: its size is known here, one row per day of the grid's span, and
    ``date`` itself ends it at 3.7 million rows (years 1 to 9999).
    """
    grid = list(grid)
    if not grid or any(b <= a for a, b in zip(grid, grid[1:])):
        raise ValueError("a grid needs at least one date, in strictly ascending order")
    ends = F.when(date <= F.lit(grid[0]), 0).when(date > F.lit(grid[-1]), len(grid))
    if len(grid) == 1:
        return df.withColumn(name, ends)
    calendar = F.broadcast(grid_calendar(df, grid).withColumnRenamed("slot", "_slot"))
    return (
        df.withColumn("_at", date)
        .join(calendar, F.col("_at") == F.col("_day"), "left")
        .withColumn(name, F.coalesce(F.col("_slot"), ends))
        .drop("_at", "_day", "_slot")
    )


def slot_of(df: DataFrame, grid: Sequence[dt.date], cols: PanelColumns = PANEL) -> DataFrame:
    """``with_slot`` on the panel's date, without the rows no grid date sees."""
    return with_slot(df.where(F.col(cols.date) <= F.lit(grid[-1])), F.col(cols.date), grid)


def newest_per_slot(observations: DataFrame, grid: Sequence[dt.date], cols: PanelColumns = PANEL) -> DataFrame:
    """Newest row of each series per slot, from a canonical frame."""
    slotted = slot_of(observations, grid, cols)
    return slotted.groupBy(*cols.series_key, "slot").agg(
        F.max_by(cols.value, cols.date).alias("value"),
        F.max(cols.date).alias("observed_on"),
    )


def _newest_with_lags(daily: DataFrame, grid: Sequence[dt.date], lags: Sequence[int], cols: PanelColumns = PANEL) -> DataFrame:
    """``newest_per_slot`` with lags and ``_until``, the last slot a row holds for, by the one sort that lags need.

    Slots rise with the date, so a slot's newest row is the one before a later slot's row, which
    ends its time. No second order and no aggregate is held beside the sorted rows.
    """
    # in one select, so that Spark sees one order
    rows = slot_of(daily, grid, cols).select("*", *_anchor_lags(lags, cols), F.lead("slot").over(_by_day(cols)).alias("_next"))
    return rows.where("_next IS NULL OR _next > slot").select(
        *cols.series_key, "slot", F.col(cols.value).alias("value"), F.col(cols.date).alias("observed_on"),
        *[f"lag_{n}d" for n in lags], F.coalesce(F.col("_next") - 1, F.lit(len(grid) - 1)).alias("_until"),
    )


def spread_over_grid(newest: DataFrame, grid: Sequence[dt.date], cols: PanelColumns = PANEL, points: Column | None = None) -> DataFrame:
    """Repeat each slot's row up to the series' next slot with news: one row per answered date.

    ``points`` is the grid as an array column, for grids that are not of dates.
    """
    series = Window.partitionBy(*cols.series_key).orderBy("slot")
    last_slot = F.coalesce(F.lead("slot").over(series) - 1, F.lit(len(grid) - 1))
    return _repeated(newest.withColumn("_until", last_slot), grid, points)


def _repeated(filled: DataFrame, grid: Sequence[dt.date], points: Column | None = None) -> DataFrame:
    """One row per slot from ``slot`` to ``_until``."""
    return (
        filled.withColumn("slot", F.explode(F.sequence("slot", "_until")))
        .withColumn("as_of", F.element_at(F.array(*[F.lit(d) for d in grid]) if points is None else points, F.col("slot") + 1))
        .drop("_until")
    )


def daily_rows(panel: DataFrame, until: dt.date, priority: Sequence[str] = (), one_row_per_day: bool = False,
               cols: PanelColumns = PANEL) -> DataFrame:
    """The canonical panel up to a date, as (entity, indicator, date, value)."""
    bounded = panel.where(F.col(cols.date) <= F.lit(until))
    daily = bounded if one_row_per_day else canonical_panel(bounded, priority, cols)
    return daily.select(*cols.series_key, cols.date, cols.value)


def answers_on_grid(daily: DataFrame, grid: Sequence[dt.date], lags: Sequence[int] = (),
                    cols: PanelColumns = PANEL) -> DataFrame:
    """As-of rows of an already canonical frame; keeps whatever partitioning it comes with."""
    if lags:
        return _repeated(_newest_with_lags(daily, grid, lags, cols), grid)
    return spread_over_grid(newest_per_slot(daily, grid, cols), grid, cols)


def asof_grid(
    panel: DataFrame,
    grid: Sequence[dt.date],
    lags: Sequence[int] = (),
    priority: Sequence[str] = (),
    one_row_per_day: bool = False,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """As-of value, its date and its lags for every series and every grid date it answers.

    ``one_row_per_day`` skips the canonical pick when the caller's panel already has one source
    per series, saving a shuffle.
    """
    return answers_on_grid(daily_rows(panel, grid[-1], priority, one_row_per_day, cols), grid, lags, cols)


def asof_join(
    probes: DataFrame,
    panel: DataFrame,
    probe_date: str = "as_of",
    priority: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """As-of join for probe dates that live in a table instead of on the driver.

    Probes and observations are unioned and walked in date order by one window per series, so
    history is never multiplied by probes. Observations sort before probes of the same day, and
    value and date travel in one struct. Probes are reduced to distinct (series, date) first and
    joined back, so a date asked for many times costs one row in the window.
    """
    found = F.struct(F.col(cols.value).alias("value"), F.col(cols.date).alias("observed_on"))
    answers = canonical_panel(panel, priority, cols).select(
        *cols.series_key, F.col(cols.date).alias("_at"), F.lit(0).alias("_side"), found.alias("_row")
    )
    wanted = probes.select(*cols.series_key, F.col(probe_date).alias("_at")).distinct()
    asked = wanted.select(*cols.series_key, "_at", F.lit(1).alias("_side"),
                          F.lit(None).cast(answers.schema["_row"].dataType).alias("_row"))
    walk = Window.partitionBy(*cols.series_key).orderBy("_at", "_side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    resolved = (
        answers.unionByName(asked)
        .withColumn("_hit", F.last("_row", ignorenulls=True).over(walk))
        .where(F.col("_side") == 1)
        .select(
            *cols.series_key,
            F.col("_at").alias(probe_date),
            F.col("_hit.value").alias("value"),
            F.col("_hit.observed_on").alias("observed_on"),
        )
    )
    return probes.join(resolved, [*cols.series_key, probe_date], "left")
