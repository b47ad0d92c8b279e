"""Exact linear-interpolation quantiles per series.

``percentile`` keeps a value -> count map per group, and expanding quantiles count over one sorted
order per series. That is right for series that fit in a task.
The series are counted first, in one pass that combines map-side; only if some hold at least
``LARGE_SERIES_ROWS`` rows does the plan get a second way for them, which narrows ranges of values
until each holds a single value. Both ways are exact.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.operators.asof import slot_of
from panelcycle.operators.rank_trees import running_quantiles
from panelcycle.operators.vintages import revision_spans
from panelcycle.schema import PANEL, PanelColumns, present
from panelcycle.session import materialize

LARGE_SERIES_ROWS = 5_000_000
# Parts that a range of values is cut into per round. A round's groups hold one row per part and
# slot, however many rows the series has.
PARTS = 1_024


def quantile_name(p: float) -> str:
    return f"q{round(p * 100):02d}"


def _large_series(values: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """Series of at least ``limit`` rows with their size and extremes, as a table; None if there are none."""
    sizes = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    large = materialize(sizes.where(F.col("n_obs") >= limit), "large-series")
    return large if large.limit(1).count() else None


def _part() -> Column:
    """Which part of its range a value lies in: never less for a larger value, and different for the two ends."""

    def half(c: str) -> Column:  # halves of finite values, so that no difference overflows
        largest = F.lit(sys.float_info.max)
        return F.greatest(F.least(F.col(c), largest), -largest) / 2

    span = half("_high") - half("_low")
    scaled = F.floor((half("_v") - half("_low")) / F.nullif(span, F.lit(0.0)) * PARTS).cast("int")
    return F.coalesce(scaled, (F.col("_v") > F.col("_low")).cast("int"))


def _values_at(rows: DataFrame, large: DataFrame, targets: DataFrame, keys: list[str], last: int) -> DataFrame:
    """(keys, slot, _rank, _value): the value at a 0-based rank among a series' rows up to a slot.

    ``rows`` (keys, slot, _v) are the large series' own; ``targets`` (keys, slot, _rank) are few. Per
    round every open range of values is cut into parts, the parts are counted by slot, and only
    those that hold a wanted rank stay open. Ranges are disjoint, so a row meets one of them at
    most. Rounds end when every open range is one value; each round parts the two ends of a range.
    """
    place = [*keys, "_range"]
    rows = rows.groupBy(*keys, "slot", "_v").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_range", F.lit(""))
    ranges = large.select(*keys, F.lit("").alias("_range"), "_low", "_high")
    targets = targets.withColumns({"_range": F.lit(""), "_left": F.col("_rank")})
    deeper = F.concat_ws(".", "_range", "_part").alias("_range")
    found = []
    while True:
        placed = materialize(
            rows.join(ranges, place).select(*place, "slot", "_v", "_copies", _part().alias("_part")), "quantile-rows"
        )
        counts = placed.groupBy(*place, "_part", "slot").agg(
            F.sum("_copies").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        part = Window.partitionBy(*place, "_part")
        so_far = part.orderBy("slot")
        held = counts.select(
            *place, "_part", "slot", F.sum("_n").over(so_far).alias("_n"), F.lead("slot").over(so_far).alias("_next"),
            F.min("_least").over(part).alias("_low"), F.max("_most").over(part).alias("_high"),
        ).withColumn("slot", F.explode(F.sequence("slot", F.coalesce(F.col("_next") - 1, F.lit(last)))))
        held = held.join(targets.select(*place, "slot").distinct(), [*place, "slot"], "left_semi")
        in_order = Window.partitionBy(*place, "slot").orderBy("_part")
        starts = held.withColumn("_before", F.sum("_n").over(in_order) - F.col("_n"))
        here = (F.col("_left") >= F.col("_before")) & (F.col("_left") < F.col("_before") + F.col("_n"))
        hit = materialize(
            starts.join(targets, [*place, "slot"]).where(here).select(
                *keys, deeper, "slot", "_rank", (F.col("_left") - F.col("_before")).alias("_left"), "_low", "_high"
            ),
            "quantile-ranges",
        )
        found.append(hit.where("_low = _high").select(*keys, "slot", "_rank", F.col("_low").alias("_value")))
        open_ = hit.where("_low < _high")
        if not open_.limit(1).count():
            break
        targets = open_.select(*place, "slot", "_rank", "_left")
        ranges = open_.select(*place, "_low", "_high").distinct()
        rows = placed.select(*keys, deeper, "slot", "_v", "_copies")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _by_ranks(rows: DataFrame, large: DataFrame, sizes: DataFrame, keys: list[str], probs: Sequence[float], last: int = 0) -> DataFrame:
    """Quantiles as an array ``_q`` beside the rows of ``sizes`` (keys, slot, n_obs, ...) of the large series."""
    positions = [F.lit(float(p)) * (F.col("n_obs") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(pos) for pos in positions for f in (F.floor, F.ceil)]))
    found = _values_at(rows, large, sizes.select(*keys, "slot", F.explode(ranks).alias("_rank")), keys, last)
    held = found.groupBy(*keys, "slot").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))
    blended = []
    for position in positions:
        lower, upper = F.floor(position), F.ceil(position)
        low, high = F.element_at("_at", lower), F.element_at("_at", upper)
        blended.append(F.when(lower == upper, low).otherwise((upper - position) * low + (position - lower) * high))
    return sizes.join(held, [*keys, "slot"]).withColumn("_q", F.array(*blended)).drop("_at")


def series_quantiles(
    panel: DataFrame,
    probs: Sequence[float],
    min_observations: int = 1,
    keys: Sequence[str] | None = None,
    large_series_rows: int | None = LARGE_SERIES_ROWS,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Quantiles of every series over the rows of all sources; NULL below ``min_observations``.

    ``large_series_rows=None`` plans the ordinary way alone, without counting first. It is for panels
    with one row per series and day, where the calendar already bounds a series (366 values a year).
    """
    keys = list(keys or cols.series_key)
    values = panel.where(present(F.col(cols.value))).select(*keys, F.col(cols.value).alias("_v"))
    large = None if large_series_rows is None else _large_series(values, keys, large_series_rows)
    small = values if large is None else values.join(large.select(*keys), keys, "left_anti")
    found = small.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obs"), F.percentile("_v", [float(p) for p in probs]).alias("_q")
    )
    if large is not None:
        rows = values.join(large.select(*keys), keys, "left_semi").withColumn("slot", F.lit(0))
        sizes = large.select(*keys, F.lit(0).alias("slot"), "n_obs")
        found = found.unionByName(_by_ranks(rows, large, sizes, keys, probs).select(*keys, "n_obs", "_q"))
    enough = F.col("n_obs") >= min_observations
    return found.select(*keys, "n_obs", *[F.when(enough, F.col("_q")[i]).alias(quantile_name(p)) for i, p in enumerate(probs)])


def expanding_quantiles(
    panel: DataFrame,
    grid: Sequence[dt.date],
    probs: Sequence[float],
    min_observations: int = 1,
    large_series_rows: int | None = LARGE_SERIES_ROWS,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """Quantiles of every series as they stood on each grid date, over the rows up to that date.

    A series' values are sorted once; its slots then keep counts over that order, so a slot with
    news costs its own rows and a search (``operators.rank_trees``), and holds until the next one. The
    large series' values are counted by slot instead, and their rows are never repeated for later dates.
    """
    keys = cols.series_key
    usable = panel.where(present(F.col(cols.value))).select(*keys, cols.date, F.col(cols.value).alias("_v"))
    values = slot_of(usable, grid, cols).select(*keys, "_v", "slot")
    large = None if large_series_rows is None else _large_series(values, list(keys), large_series_rows)
    walked = values if large is None else values.join(large.select(*keys), list(keys), "left_anti")

    so_far = Window.partitionBy(*keys).orderBy("slot")
    last = len(grid) - 1
    news = running_quantiles(walked.withColumn("_sign", F.lit(1)), list(keys), probs)
    if large is not None:
        rows = values.join(large.select(*keys), list(keys), "left_semi")
        per_slot = rows.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("_n"))
        sizes = per_slot.select(
            *keys, "slot", F.sum("_n").over(so_far).alias("n_obs"), F.lead("slot").over(so_far).alias("_next")
        )
        news = news.unionByName(_by_ranks(rows, large, sizes, list(keys), probs, last))
    return _on_grid(news, grid, keys, probs, min_observations)


def _on_grid(news: DataFrame, grid: Sequence[dt.date], keys: Sequence[str], probs: Sequence[float], min_observations: int) -> DataFrame:
    """Rows per slot with news, held until the next one, as rows per date."""
    held = news.withColumn("slot", F.explode(F.sequence("slot", F.coalesce(F.col("_next") - 1, F.lit(len(grid) - 1)))))
    enough = F.col("n_obs") >= min_observations
    dates = F.array(*[F.lit(d) for d in grid])
    return held.select(
        *keys, F.element_at(dates, F.col("slot") + 1).alias("as_of"), "n_obs",
        *[F.when(enough, F.col("_q")[i]).alias(quantile_name(p)) for i, p in enumerate(probs)],
    )


def vintage_quantiles(
    log: DataFrame,
    grid: Sequence[dt.date],
    known_by: Sequence[dt.date | dt.datetime],
    probs: Sequence[float],
    min_observations: int = 1,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """``expanding_quantiles`` over a log of revisions: each date sees the values that were loaded by its load time.

    A value is counted at the slot that first sees it and taken out again at the slot of the revision
    that replaces it.
    """
    keys = cols.series_key
    usable = log.where(present(F.col(cols.value)))
    spans = revision_spans(usable, grid, known_by, cols)
    steps = F.array(
        F.struct(F.col("slot").alias("slot"), F.lit(1).alias("_sign")), F.struct(F.col("_until").alias("slot"), F.lit(-1).alias("_sign"))
    )
    events = spans.select(*keys, F.col(cols.value).alias("_v"), F.inline(steps)).where(F.col("slot").isNotNull())
    return _on_grid(running_quantiles(events, keys, probs), grid, keys, probs, min_observations)
