"""As-of lookups and lags on timestamps, for series that no calendar bounds.

- A grid gives each row its slot by binary search (``slots``). Only the newest row per series and slot
  is kept, by an aggregate that combines before the shuffle, so a series is bounded by the grid.
- Probes and lags that live in tables need the rows themselves in order. Time is cut into blocks of
  ``block``; a series' block is one task's work. The newest row of each block is carried into the
  blocks after it, by a window over the series' blocks alone. What a block cannot answer from its own
  rows is answered by what is carried in. A series is so never ordered as a whole; what one task holds
  is what one series reports in one block, and the block's length is the caller's.

Rows of one time are told apart by ``ties``, columns of which the greatest wins. ``cols.date`` names a
timestamp or date column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.operators.asof import spread_over_grid
from panelcycle.operators.slots import check_grid, grid_array, with_first_slot
from panelcycle.schema import PANEL, PanelColumns

HOUR = dt.timedelta(hours=1)


def hourly_grid(start: dt.datetime, end: dt.datetime, step: dt.timedelta = HOUR) -> list[dt.datetime]:
    return [start + i * step for i in range((end - start) // step + 1)]


def _newest(found: Column, ties: Sequence[str], cols: PanelColumns) -> Column:
    return F.max_by(found, F.struct(cols.date, *ties))


def asof_time_grid(
    observations: DataFrame,
    grid: Sequence[dt.datetime],
    ties: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """(series key, as_of, value, observed_at) for every series and every grid time it answers."""
    grid = check_grid(grid)
    seen = with_first_slot(observations.where(F.col(cols.date) <= _instant(grid[-1], observations, cols)), cols.date, grid)
    found = F.struct(F.col(cols.value).alias("value"), F.col(cols.date).alias("observed_at"))
    newest = seen.groupBy(*cols.series_key, "slot").agg(_newest(found, ties, cols).alias("_row"))
    points = grid_array(grid, observations.schema[cols.date].dataType.simpleString())
    return spread_over_grid(newest.select(*cols.series_key, "slot", "_row.*"), grid, cols, points)


def _instant(at: dt.datetime | dt.date, frame: DataFrame, cols: PanelColumns) -> Column:
    return F.lit(str(at)).cast(frame.schema[cols.date].dataType)


def _block(at: Column, block: dt.timedelta) -> Column:
    """Number of the block of time. Wall times are read as instants: only their order and distance count."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(int(block / dt.timedelta(microseconds=1)))).cast("bigint")


def asof_time_join(
    probes: DataFrame,
    observations: DataFrame,
    probe_time: str = "as_of",
    block: dt.timedelta = HOUR,
    ties: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """``probes`` with ``value`` and ``observed_at`` of the newest row at or before their time, null if none.

    A probe whose time or series is null finds nothing. Probes are reduced to distinct ones first and
    joined back, so a time asked for many times is looked up once.
    """
    keys = cols.series_key
    found = F.struct(F.col(cols.value).alias("value"), F.col(cols.date).alias("observed_at"))
    order = F.struct(F.col(cols.date), *ties)
    rows = observations.select(
        *keys, F.col(cols.date).alias("_at"), F.lit(0).alias("_side"), *[F.col(t).alias(f"_tie_{i}") for i, t in enumerate(ties)],
        found.alias("_row"), order.alias("_order"), _block(F.col(cols.date), block).alias("_block"),
    )
    wanted = probes.select(*keys, F.col(probe_time).alias("_at")).where(F.col("_at").isNotNull()).distinct()
    asked = wanted.select(*keys, "_at", F.lit(1).alias("_side"), _block(F.col("_at"), block).alias("_block"))
    # one row per series and block: its newest observation, null for a block that only has probes
    newest = rows.groupBy(*keys, "_block").agg(F.max_by("_row", "_order").alias("_last"))
    asked_blocks = asked.select(*keys, "_block").distinct()
    blocks = newest.unionByName(asked_blocks, allowMissingColumns=True).groupBy(*keys, "_block").agg(
        F.first("_last", ignorenulls=True).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy(*keys, "_block").orderBy("_at", "_side", *[f"_tie_{i}" for i in range(len(ties))]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    walked = rows.drop("_order").unionByName(asked, allowMissingColumns=True).select(
        *keys, "_block", "_at", "_side", F.last("_row", ignorenulls=True).over(within).alias("_hit")
    ).where(F.col("_side") == 1)
    same = [walked[k].eqNullSafe(carried[k]) for k in keys] + [walked["_block"] == carried["_block"]]
    resolved = walked.join(carried, same, "left").select(
        *[walked[k] for k in keys], F.col("_at").alias(probe_time), F.coalesce("_hit", "_carried").alias("_found")
    ).where(F.col("_found").isNotNull())
    return probes.join(resolved, [*keys, probe_time], "left").withColumns(
        {"value": F.col("_found.value"), "observed_at": F.col("_found.observed_at")}
    ).drop("_found")


def with_time_lags(
    observations: DataFrame,
    lags: Mapping[str, dt.timedelta],
    block: dt.timedelta = HOUR,
    ties: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Add per lag the series' value at or before (row time - lag), null if none."""
    out = observations
    for name, distance in lags.items():
        micros = int(distance / dt.timedelta(microseconds=1))
        then = F.col(cols.date) - F.expr(f"make_dt_interval(0, 0, 0, {micros // 10**6}.{micros % 10**6:06d})")
        asked = out.withColumn("_then", then)
        found = asof_time_join(asked.select(*cols.series_key, "_then").distinct(), observations, "_then", block, ties, cols)
        found = found.select(*cols.series_key, "_then", F.col("value").alias("_lagged"))
        out = asked.join(found, [*cols.series_key, "_then"], "left").withColumn(name, F.col("_lagged")).drop("_then", "_lagged")
    return out
