"""Trailing z-score of a series' newest value."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.catalog.entities import SIGNAL_ENTITIES
from panelcycle.catalog.indicators import SIGNAL_INDICATOR, SIGNAL_WINDOW_DAYS
from panelcycle.catalog.thresholds import MIN_OBSERVATIONS
from panelcycle.operators.asof import with_slot
from panelcycle.operators.canonical import recency
from panelcycle.operators.slots import first_slot
from panelcycle.operators.vintages import revision_spans
from panelcycle.schema import PANEL, PanelColumns


def _finish(stats: DataFrame, min_observations: int) -> DataFrame:
    """``latest`` and ``z`` from the window's count, newest value, mean, deviation and extremes."""
    enough = F.col("n_obs") >= min_observations
    # a constant window scores 0; min = max is exact where a computed deviation may not be 0
    z = F.when(F.col("_low") == F.col("_high"), F.lit(0.0)).otherwise(
        F.try_divide(F.col("_latest") - F.col("_mean"), F.col("_std"))
    )
    return stats.withColumns(
        {"latest": F.when(enough, F.col("_latest")), "z": F.when(enough, z)}
    ).drop("_latest", "_mean", "_std", "_low", "_high")


def trailing_zscore(
    panel: DataFrame,
    today: dt.date,
    window_days: int = SIGNAL_WINDOW_DAYS,
    min_observations: int = MIN_OBSERVATIONS,
    priority: Sequence[str] = (),
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """z of the newest value against the rows since ``today - window_days``, per series.

    One combined aggregate; every buffer is a primitive.
    """
    start = today - dt.timedelta(days=window_days)
    recent = panel.where(F.col(cols.date) >= F.lit(start)).select(
        *cols.series_key,
        F.col(cols.value).alias("_v"),
        recency(F.col(cols.date), F.col(cols.source), priority).alias("_recency"),
    )
    stats = recent.groupBy(*cols.series_key).agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max_by("_v", "_recency").alias("_latest"),
        F.avg("_v").alias("_mean"),
        F.stddev_pop("_v").alias("_std"),
        F.min("_v").alias("_low"),
        F.max("_v").alias("_high"),
    )
    return _finish(stats, min_observations)


_MOMENTS = ("_n", "_s1", "_s2")


def _running(parts: DataFrame, by: list[str], order: str, falling: bool) -> DataFrame:
    """Moments, extremes and newest value of all parts of a period up to each one, in the order given."""
    summed = parts.groupBy(*by, order).agg(
        *[F.sum(c).alias(c) for c in _MOMENTS], F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        F.max_by("_latest", "_recency").alias("_latest"), F.max("_recency").alias("_recency"), F.max("_centre").alias("_centre"),
    )
    frame = Window.partitionBy(*by).orderBy(F.col(order).desc() if falling else F.col(order).asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return summed.select(
        *by, order, "_centre", F.lead(order).over(Window.partitionBy(*by).orderBy(order)).alias("_next"),
        F.lag(order).over(Window.partitionBy(*by).orderBy(order)).alias("_before"),
        *[F.sum(c).over(frame).alias(c) for c in _MOMENTS], F.min("_low").over(frame).alias("_low"), F.max("_high").over(frame).alias("_high"),
        F.max_by("_latest", "_recency").over(frame).alias("_latest"), F.max("_recency").over(frame).alias("_recency"),
    )


def trailing_zscore_grid(
    panel: DataFrame,
    grid: Sequence[dt.date],
    window_days: int = SIGNAL_WINDOW_DAYS,
    min_observations: int = MIN_OBSERVATIONS,
    priority: Sequence[str] = (),
    known_by: Sequence[dt.date | dt.datetime] | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """The same score as it stood on each grid date, seeing nothing later than that date.

    Time is cut into periods as long as the window. A date's window is then the head of its own period,
    up to the date, and the tail of the period before, from the window's first day. Heads and tails are
    running sums, forwards and backwards, of moments about the period's own middle (the median of its
    parts, which an outlier does not move), so each series has two rows per date to merge and no row or
    block is repeated over the dates that see it. Nothing is ever subtracted: a value that has left the
    window leaves no rounding behind. Digits are lost only where a window's level is far from its
    period's middle: a deviation below some 1e-8 of that distance.

    With ``known_by`` the panel is a log of revisions, see ``operators.vintages``; values then come and go
    in any order, and each is held over an interval of dates, see ``aligned_ranges``.
    """
    if known_by is not None:
        return _zscore_of_vintages(panel, grid, known_by, window_days, min_observations, priority, cols)
    keys, length = cols.series_key, window_days + 1
    dated = panel.where(F.col(cols.date) <= F.lit(grid[-1])).select(
        *keys, cols.date,
        F.col(cols.value).alias("_v"),
        recency(F.col(cols.date), F.col(cols.source), priority).alias("_recency"),
    )
    start = F.lit(grid[0])
    entered = with_slot(dated, F.col(cols.date), grid, "_first")
    bounded = with_slot(entered, F.date_add(cols.date, length), grid, "_after").withColumn(
        "_period", F.floor(F.datediff(cols.date, start) / length).cast("int")
    )
    by = [*keys, "_period"]
    # combined before the shuffle: at most two parts per grid date and series, and one more per period
    parts = bounded.where(F.col("_first") < F.col("_after")).groupBy(*by, "_first", "_after").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_var"),
        F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        F.max_by("_v", "_recency").alias("_latest"), F.max("_recency").alias("_recency"),
    ).repartition(*keys)
    period = Window.partitionBy(*by)
    centred = parts.withColumn("_centre", F.median("_m").over(period))
    off = F.col("_m") - F.col("_centre")
    parts = centred.withColumns({"_s1": F.col("_n") * off, "_s2": F.col("_n") * (F.col("_var") + off * off)})

    def opening(period: Column) -> Column:  # first slot of a period
        return first_slot(F.date_add(start, period * length), grid, "date")

    heads = _running(parts, by, "_first", falling=False).withColumns(
        {"_from": F.col("_first"), "_to": F.least(F.coalesce(F.col("_next") - 1, F.lit(len(grid))), opening(F.col("_period") + 1) - 1)}
    )
    tails = _running(parts, by, "_after", falling=True).withColumns(
        {"_from": F.greatest(F.coalesce("_before", F.lit(0)), opening(F.col("_period") + 1)),
         "_to": F.least(F.col("_after") - 1, opening(F.col("_period") + 2) - 1)}
    )
    columns = [*keys, "_from", "_to", "_centre", *_MOMENTS, "_low", "_high", "_latest", "_recency"]
    both = heads.select(*columns).unionByName(tails.select(*columns)).where(F.col("_from") <= F.col("_to"))
    own = F.col("_s1") / F.col("_n")
    halves = both.withColumns({
        "_slot": F.explode(F.sequence("_from", "_to")), "_mean": F.col("_centre") + own,
        "_within": F.greatest(F.col("_s2") - F.col("_s1") * own, F.lit(0.0)),
    })
    n = F.sum("_n")
    apart = F.max("_mean") - F.min("_mean")  # of the two halves; with one half they are the same
    merged = halves.groupBy(*keys, "_slot").agg(
        n.alias("n_obs"), (F.sum(F.col("_n") * F.col("_mean")) / n).alias("_mean"),
        F.sqrt((F.sum("_within") + (n * n - F.sum(F.col("_n") * F.col("_n"))) / 2 / n * apart * apart) / n).alias("_std"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.max_by("_latest", "_recency").alias("_latest"),
    )
    dates = F.array(*[F.lit(d) for d in grid])
    return _finish(merged.withColumn("as_of", F.element_at(dates, F.col("_slot") + 1)).drop("_slot"), min_observations)


def _zscore_of_vintages(log: DataFrame, grid: Sequence[dt.date], known_by: Sequence[dt.date | dt.datetime], window_days: int,
                        min_observations: int, priority: Sequence[str], cols: PanelColumns) -> DataFrame:
    """Scores over the values held at each date.

    A value is held over an interval of slots. Intervals are cut into aligned ranges, the values of a range are
    merged, and a slot merges the ranges around it: a series has rows in number of its values and its slots
    times the logarithm of the grid, whatever the order in which values come and go, and nothing is subtracted.
    """
    spans = revision_spans(log, grid, known_by, cols)
    left = with_slot(spans, F.date_add(cols.date, window_days + 1), grid, "_left")
    held = left.select(
        *cols.series_key, F.col("slot").alias("_first"), F.least("_left", "_until").alias("_after"), F.col(cols.value).alias("_v"),
        recency(F.col(cols.date), F.col(cols.source), priority).alias("_recency"),
    )
    blocks = (
        held.where(F.col("_first") < F.col("_after"))
        .groupBy(*cols.series_key, "_first", "_after")
        .agg(
            F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var"), F.min("_v").alias("_low"),
            F.max("_v").alias("_high"), F.max_by("_v", "_recency").alias("_latest"), F.max("_recency").alias("_recency"),
        )
        .repartition(*cols.series_key)
    )
    figures = ("_n", "_mean", "_var", "_low", "_high", "_latest", "_recency")
    cut = blocks.select(*cols.series_key, *figures, F.inline_outer(aligned_ranges(F.col("_first"), F.col("_after"), len(grid))))
    ranges = _merged(cut, [*cols.series_key, "_level", "_place"])
    inside = F.expr("sequence(shiftleft(_place, _level), shiftleft(_place + 1, _level) - 1)")
    covered = ranges.select(*cols.series_key, *figures, F.explode_outer(inside).alias("_slot"))
    merged = _merged(covered, [*cols.series_key, "_slot"])
    dates = F.array(*[F.lit(d) for d in grid])
    stats = merged.withColumns({"as_of": F.element_at(dates, F.col("_slot") + 1), "_std": F.sqrt("_var")})
    return _finish(stats.withColumnRenamed("_n", "n_obs").drop("_slot", "_var", "_recency"), min_observations)


def aligned_ranges(first: Column, after: Column, slots: int) -> Column:
    """The slots from ``first`` until before ``after`` as ranges of 2^level slots that begin at a multiple of their length.

    An array of (_level, _place), for the range that begins at _place * 2^level: two a level at most, so an
    interval of any length has no more than twice the logarithm of the grid's, and none of them overlap.
    """
    ranges = []
    for level in range(slots.bit_length()):
        low, high = F.shiftright(first + (2**level - 1), level), F.shiftright(after, level)  # whole ranges inside
        ranges += [
            F.when((low < high) & (side % 2 == 1), F.struct(F.lit(level).alias("_level"), place.alias("_place")))
            for side, place in ((low, low), (high, high - 1))  # the odd ones at either end; pairs of the others are ranges of the next level
        ]
    return F.array_compact(F.array(*ranges))


def _merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Count, mean, variance, extremes and newest value of parts that have these figures themselves.

    The common mean comes first: squares of deviations from it do not cancel at high levels.
    """
    n, off = F.col("_n"), F.col("_mean") - F.col("_centre")
    group = Window.partitionBy(*by)
    total = F.sum(n)
    return (
        parts.withColumn("_centre", F.sum(n * F.col("_mean")).over(group) / F.sum(n).over(group))
        .groupBy(*by)
        .agg(
            total.alias("_n"), F.max("_centre").alias("_mean"), (F.sum(n * (F.col("_var") + off * off)) / total).alias("_var"),
            F.min("_low").alias("_low"), F.max("_high").alias("_high"),
            F.max_by("_latest", "_recency").alias("_latest"), F.max("_recency").alias("_recency"),
        )
    )


def credit_signal(
    panel: DataFrame,
    today: dt.date | None = None,
    grid: Sequence[dt.date] | None = None,
    enabled: Sequence[str] = SIGNAL_ENTITIES,
    priority: Sequence[str] = (),
    known_by: Sequence[dt.date | dt.datetime] | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Credit-spread level and z-score of the enabled entities, as columns of a snapshot.

    Only the listed entities have the signal; their names filter the scan.

    With ``today`` one row per entity; with ``grid`` one row per entity and date, over a log of revisions with ``known_by``.
    """
    spread = panel.where((F.col(cols.indicator) == SIGNAL_INDICATOR) & cols.entity_in(enabled))
    if grid is None:
        scored = trailing_zscore(spread, today, priority=priority, cols=cols)
        keys = cols.entity_key
    else:
        scored = trailing_zscore_grid(spread, grid, priority=priority, known_by=known_by, cols=cols)
        keys = [*cols.entity_key, "as_of"]
    return scored.select(*keys, F.col("latest").alias("hy_spread"), F.col("z").alias("hy_spread_z"))
