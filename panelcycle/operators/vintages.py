"""What was known when: as-of over a log of revisions, by date and by load time.

A grid point asks for the newest row dated at or before it among those loaded by its load time. Grid
dates rise and load times never fall, so a revision that a point can see stays in sight of all later
ones: it has one slot, the later of the slots of its date and of its load time. What holds at a point
is the greatest row, by date, source and load time, over the slots up to it: a running maximum, for
which revisions are never paired with dates.

Lags hang on the row found. As that row's date only rises too, a row comes into the reach of a lag
of n days at the first slot that holds a date n days after its own, and is in reach from then on: the
least slot among the rows that much younger, which is a growing frame over the dates. A lag is again
a running maximum, over those slots.

A null load time counts as known from the start. Revisions of one load time follow their order in
``arrival``, and their values where that is equal or absent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.operators.asof import spread_over_grid
from panelcycle.operators.canonical import source_rank
from panelcycle.operators.slots import check_grid, first_slot, with_first_slot
from panelcycle.schema import PANEL, PanelColumns

ARRIVAL = "arrival"


def with_visible_slot(
    log: DataFrame, grid: Sequence[dt.date], known_by: Sequence[dt.date | dt.datetime], cols: PanelColumns = PANEL
) -> DataFrame:
    """Add ``slot``, the first grid point that sees the revision; revisions no point sees are left out."""
    grid, known_by = check_grid(grid), check_grid(known_by, strictly=False)
    if len(grid) != len(known_by):
        raise ValueError("known_by needs one load time per grid date")
    loaded = log.schema[cols.fetched_at].dataType.simpleString()
    by_load = F.coalesce(first_slot(F.col(cols.fetched_at), known_by, loaded), F.lit(0))
    dated = with_first_slot(log.where(F.col(cols.date) <= F.lit(grid[-1])), cols.date, grid, "_by_date")
    return dated.withColumn("slot", F.greatest("_by_date", by_load)).drop("_by_date").where(F.col("slot") < len(grid))


def _newer(log: DataFrame, cols: PanelColumns) -> list[Column]:
    """What tells the newer of two revisions of a key, first things first."""
    arrival = [F.col(ARRIVAL).alias("_arrival")] if ARRIVAL in log.columns else []
    return [F.col(cols.fetched_at).alias("_loaded"), *arrival, F.col(cols.value).alias("_value")]


def vintage_answers(
    log: DataFrame,
    grid: Sequence[dt.date],
    known_by: Sequence[dt.date | dt.datetime],
    lags: Sequence[int] = (),
    priority: Sequence[str] = (),
    markers: DataFrame | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """As-of value, its date and its lags for every series and every grid point, as known by the point's load time.

    Same-day sources follow ``priority`` among those that were loaded. The columns are those of
    ``asof_grid``; ``markers`` are rows (entity, indicator, date, value) seen from the first point on.
    """
    keys = cols.series_key
    seen = with_visible_slot(log, grid, known_by, cols)
    if markers is not None:
        seen = seen.unionByName(markers.withColumn("slot", F.lit(0)), allowMissingColumns=True)
    rank = -source_rank(F.col(cols.source), priority)
    # one row per day and slot with news, however often it was revised in between; combined before the shuffle
    news = seen.groupBy(*keys, cols.date, "slot").agg(F.max(F.struct(rank.alias("_rank"), *_newer(seen, cols))).alias("_row"))
    news = news.repartition(*cols.entity_key)
    # youngest first, so that the frame of all rows n days younger grows row by row
    youngest_first = Window.partitionBy(*keys).orderBy(-F.unix_date(cols.date))
    reaches = {
        f"_reach_{k}": F.min("slot").over(youngest_first.rangeBetween(Window.unboundedPreceding, -n)) for k, n in enumerate(lags, start=1)
    }
    news = news.withColumns(reaches) if reaches else news
    # null where no younger row is: greatest() would skip it
    slots = [F.col("slot"), *[F.when(F.col(reach).isNotNull(), F.greatest("slot", reach)) for reach in reaches]]
    kinds = range(len(slots))
    asked = F.inline(F.array(*[F.struct(F.lit(k).alias("_kind"), slot.alias("_slot")) for k, slot in enumerate(slots)]))
    events = news.select(*keys, F.struct(F.col(cols.date).alias("_date"), F.col("_row")).alias("_found"), asked)
    best = events.where(F.col("_slot").isNotNull()).groupBy(*keys, F.col("_slot").alias("slot")).agg(
        *[F.max(F.when(F.col("_kind") == k, F.col("_found"))).alias(f"_best_{k}") for k in kinds]
    )
    so_far = Window.partitionBy(*keys).orderBy("slot")
    held = best.select(*keys, "slot", *[F.max(f"_best_{k}").over(so_far).alias(f"_best_{k}") for k in kinds])
    newest = held.select(
        *keys, "slot", F.col("_best_0._row._value").alias("value"), F.col("_best_0._date").alias("observed_on"),
        *[F.col(f"_best_{k}._row._value").alias(f"lag_{n}d") for k, n in enumerate(lags, start=1)],
    )
    return spread_over_grid(newest, grid, cols)


def asof_vintages(
    log: DataFrame,
    grid: Sequence[dt.date],
    known_by: Sequence[dt.date | dt.datetime],
    lags: Sequence[int] = (),
    priority: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """``vintage_answers`` without markers: the as-of of ``asof_grid`` with a second bound, on the load time."""
    return vintage_answers(log, grid, known_by, lags, priority, None, cols)


def revision_spans(
    log: DataFrame, grid: Sequence[dt.date], known_by: Sequence[dt.date | dt.datetime], cols: PanelColumns = PANEL
) -> DataFrame:
    """Every value with the grid points it holds for: from ``slot`` until before ``_until``, null if it is never replaced.

    A revision replaces the one before it of the same series, day and source. Those that no grid
    point sees, because a newer one came within the same slot, are left out. A day's revisions, one a
    slot at most, are ordered by one task.
    """
    keys = [*cols.series_key, cols.date, cols.source]
    seen = with_visible_slot(log, grid, known_by, cols)
    held = seen.groupBy(*keys, "slot").agg(F.max(F.struct(*_newer(seen, cols))).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("slot")
    return held.select(
        *keys, F.col("_row._value").alias(cols.value), "slot", F.lead("slot").over(order).alias("_until")
    )
