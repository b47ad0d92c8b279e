"""Upsert of a batch of observations as a join of two keyed tables.

Duplicates inside a batch count as successive revisions in arrival order: the last value wins,
the first row supplies series id and load time. Counting revisions needs the previous value of
the same key, and one key may hold a large part of a batch, so revisions are first folded inside
fixed stretches of the arrival order and the stretches are folded afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.schema import PANEL, PanelColumns

# Arrival numbers per stretch: 2**20 rows of one key at most are ordered by one task.
STRETCH_BITS = 20


def fold_batch(batch: DataFrame, arrival: str | None = None, cols: PanelColumns = PANEL,
               stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """One row per natural key: first and last value, value changes and repeats in between."""
    key = cols.natural_key
    numbered = batch.withColumn(
        "_seq", F.monotonically_increasing_id() if arrival is None else F.col(arrival).cast("bigint")
    ).withColumn("_stretch", F.shiftright("_seq", stretch_bits))

    inside = Window.partitionBy(*key, "_stretch").orderBy("_seq")
    previous = F.lag(cols.value).over(inside)
    stepped = numbered.withColumn("_step", F.when(previous.isNull(), None).otherwise((F.col(cols.value) != previous).cast("bigint")))
    stretches = stepped.groupBy(*key, "_stretch").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.coalesce(F.sum("_step"), F.lit(0)).alias("_changes"),
        F.min_by(cols.value, "_seq").alias("_first"),
        F.max_by(cols.value, "_seq").alias("_last"),
        F.min_by(F.struct(cols.series_id, cols.fetched_at), "_seq").alias("_meta"),
    )
    across = Window.partitionBy(*key).orderBy("_stretch")
    before = F.lag("_last").over(across)
    seamed = stretches.withColumn("_seam", F.when(before.isNotNull() & (before != F.col("_first")), 1).otherwise(0))
    return seamed.groupBy(*key).agg(
        F.sum("_rows").alias("batch_rows"),
        (F.sum("_changes") + F.sum("_seam")).alias("batch_changes"),
        F.min_by("_first", "_stretch").alias("first_value"),
        F.max_by("_last", "_stretch").alias("last_value"),
        F.min_by("_meta", "_stretch").alias("_meta"),
    )


def merge_observations(target: DataFrame, batch: DataFrame, arrival: str | None = None,
                       cols: PanelColumns = PANEL, stretch_bits: int = STRETCH_BITS) -> DataFrame:
    """The table after the upsert, with ``action`` and the counts each key contributes.

    Actions: ``new``, ``changed``, ``unchanged``, and ``kept`` for rows the batch did not touch.
    ``n_inserted`` counts new and changed rows together, ``n_new`` and ``n_changed`` apart.
    """
    key = cols.natural_key
    stored = target.select(
        *key, F.col(cols.value).alias("_old"), F.col(cols.series_id).alias("_old_series"),
        F.col(cols.fetched_at).alias("_old_fetched"), F.lit(True).alias("_stored"),
    )
    joined = stored.join(fold_batch(batch, arrival, cols, stretch_bits), key, "full_outer")
    is_new = F.col("_stored").isNull()
    touched = F.col("batch_rows").isNotNull()
    first_differs = (~is_new & touched & (F.col("first_value") != F.col("_old"))).cast("bigint")
    changes = F.col("batch_changes") + first_differs
    inserted = changes + is_new.cast("bigint")
    return joined.select(
        *[F.col(c) for c in key],
        F.when(touched, F.col("last_value")).otherwise(F.col("_old")).alias(cols.value),
        F.when(is_new, F.col("_meta")[cols.series_id]).otherwise(F.col("_old_series")).alias(cols.series_id),
        F.when(is_new, F.coalesce(F.col("_meta")[cols.fetched_at], F.current_timestamp()))
        .otherwise(F.col("_old_fetched")).alias(cols.fetched_at),
        F.when(~touched, "kept").when(is_new, "new").when(changes > 0, "changed").otherwise("unchanged").alias("action"),
        F.when(touched, inserted).otherwise(0).alias("n_inserted"),
        F.when(touched, F.col("batch_rows") - inserted).otherwise(0).alias("n_skipped"),
        F.when(touched & is_new, 1).otherwise(0).cast("bigint").alias("n_new"),
        F.when(touched, changes).otherwise(0).alias("n_changed"),
    )


def upsert_counts(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of an upsert, per series by default."""
    keys = PANEL.series_key if by is None else by
    return merged.groupBy(*keys).agg(
        F.sum(F.col("n_inserted") + F.col("n_skipped")).alias("rows"),
        F.sum("n_inserted").alias("inserted"),
        F.sum("n_skipped").alias("skipped"),
        F.sum("n_new").alias("new"),
        F.sum("n_changed").alias("changed"),
    )
