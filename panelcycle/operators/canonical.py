"""Natural-key checks and the one-row-per-day view of a series.

Several sources may report the same day. Every order-sensitive operator (as-of, lags) runs on
the canonical panel: one row per (entity, indicator, date), picked by source priority. The pick
is a ``min_by`` over a long, so it runs as a hash aggregate with a map-side combine, and it
bounds every series by the calendar (366 rows a year) however many copies a day has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcycle.schema import PANEL, PanelColumns

# Ranks: listed sources below _UNLISTED, hashed ones between it and _RANKS.
_UNLISTED = 1 << 20
_RANKS = 1 << 40


def source_rank(source: Column, priority: Sequence[str] = ()) -> Column:
    """Listed sources first, in list order; the others follow in a fixed, arbitrary order."""
    unlisted = F.lit(_UNLISTED) + F.pmod(F.xxhash64(source), F.lit(_RANKS - _UNLISTED))
    rank: Column | None = None
    for position, name in enumerate(priority):
        here = F.lit(position).cast("bigint")
        rank = F.when(source == name, here) if rank is None else rank.when(source == name, here)
    return unlisted if rank is None else rank.otherwise(unlisted)


def canonical_panel(panel: DataFrame, priority: Sequence[str] = (), cols: PanelColumns = PANEL) -> DataFrame:
    """One row per (entity, indicator, date): the value of the best-ranked source."""
    ranked = panel.select(
        *[F.col(c) for c in (*cols.series_key, cols.date, cols.value)],
        source_rank(F.col(cols.source), priority).alias("_rank"),
    )
    return ranked.groupBy(*cols.series_key, cols.date).agg(
        F.min_by(cols.value, "_rank").alias(cols.value)
    )


def recency(date: Column, source: Column, priority: Sequence[str] = ()) -> Column:
    """A long that orders rows by date and, within a day, by source rank (best is largest).

    Days of the years 1 to 9999 need 23 bits with sign, ranks 40, so both fit.
    """
    return F.unix_date(date).cast("bigint") * _RANKS - source_rank(source, priority)


def earliness(date: Column, source: Column, priority: Sequence[str] = ()) -> Column:
    """A long that is least for the best-ranked source of the first day."""
    return F.unix_date(date).cast("bigint") * _RANKS + source_rank(source, priority)


def duplicate_keys(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Natural keys that occur more than once, with their count. Empty for a sound panel."""
    return (
        panel.groupBy(*cols.natural_key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
