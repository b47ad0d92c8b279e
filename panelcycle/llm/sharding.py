"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly over buckets by a seeded hash; there are as many buckets
as it takes for one to fit in memory. Pass two shuffles each bucket with Fisher-Yates (Spark's
``shuffle`` of an array) and gives its rows consecutive places after the buckets before it. The
places are one random permutation of the input; shards are equal stretches of it, so their counts
are at most one apart and a bucket touches two shards at most unless shards are smaller than it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.llm.tables import fresh_name, keyed

#: Buckets that a task of the second pass takes, one after the other; rows of a group of equal ones that may share a bucket.
BUCKETS_A_TASK, EQUAL_ROWS = 16, 1000


def shuffle_into_shards(
    rows: DataFrame,
    n_shards: int,
    identity: str = "doc_id",
    text: str = "text",
    seed: int = 29,
    bucket_bytes: int = 8 << 20,
) -> DataFrame:
    """All rows and columns of ``rows`` with shard (0 to n_shards - 1) and slot (gapless from 0).

    ``bucket_bytes`` bounds the expected bytes of text in a bucket; a task holds ``BUCKETS_A_TASK`` of them.
    Records are scattered by identity and text, so null and repeated identities spread text by text.
    Rows equal in both share a bucket while they are few; where a group of them holds ``EQUAL_ROWS`` rows
    and a thousandth of all, its rows are scattered by their numbers. Null texts weigh as empty ones; an
    empty table gives an empty result, and with fewer rows than shards the later shards stay empty.
    Columns named shard or slot are replaced. A record of any length stays whole.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    weight = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 64
    total = rows.agg(F.sum(weight).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n_rows, n_buckets = total.n, max(1, math.ceil((total.bytes or 0) / bucket_bytes))
    bucket, order, first, second = (fresh_name(rows, n) for n in ("_bucket", "_order", "_h1", "_h2"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hashed = rows.select(*[F.col(f"`{c}`") for c in kept], *[
        F.xxhash64(F.lit(seed + part), keyed(identity), body).alias(name) for part, name in ((0, first), (7, second))
    ])
    scattered = hashed.withColumn(bucket, F.pmod(F.col(first), F.lit(n_buckets)))
    # of equal rows there may be any number: a thousand groups at most hold a thousandth of the rows each, and those are dealt row by row
    many = max(EQUAL_ROWS, n_rows // 1000)
    repeated = hashed.groupBy(first, second).agg(F.count(F.lit(1)).alias("_equal")).where(F.col("_equal") >= many).select(
        F.col(first).alias("_e1"), F.col(second).alias("_e2")
    ).collect()
    if repeated:
        equal = F.broadcast(rows.sparkSession.createDataFrame([tuple(r) for r in repeated], "_e1 long, _e2 long"))
        dealt = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(n_buckets))
        scattered = scattered.join(equal, (F.col(first) == F.col("_e1")) & (F.col(second) == F.col("_e2")), "left").withColumn(
            bucket, F.when(F.col("_e1").isNotNull(), dealt).otherwise(F.col(bucket))
        )
    scattered = scattered.select(*[F.col(f"`{c}`") for c in kept], bucket)

    # places of the buckets, in two levels: groups of buckets first, then the buckets of each
    counts = scattered.groupBy(F.col(bucket).alias("_of")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.expr("_of div 4096"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_size")).select(
        F.col("_group").alias("_in"), F.coalesce(F.sum("_size").over(ahead.orderBy("_group")), F.lit(0)).alias("_before")
    )
    inner = F.coalesce(F.sum("_n").over(ahead.partitionBy("_group").orderBy("_of")), F.lit(0))
    starts = counts.withColumn("_inner", inner).join(groups, F.col("_group") == F.col("_in")).select(
        "_of", (F.col("_before") + F.col("_inner")).alias("_start")
    )

    # the order before the shuffle is fixed, so a task that runs again gives the same permutation
    record = F.struct(F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in kept]).alias(order), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    buckets = scattered.repartition(math.ceil(n_buckets / BUCKETS_A_TASK), bucket).groupBy(bucket).agg(F.sort_array(F.collect_list(record)).alias("_rows"))
    placed = buckets.join(starts, F.col(bucket) == F.col("_of")).select(
        "_start", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_at", "_record")
    )
    place = F.col("_start") + F.col("_at")
    shard = F.expr(f"((_start + _at + 1) * {n_shards}L - 1) div {max(n_rows, 1)}L")
    return placed.withColumn("_shard", shard).select(
        *[F.col(f"_record.row.`{c}`").alias(c) for c in kept], F.col("_shard").cast("int").alias("shard"),
        (place - F.expr(f"(_shard * {n_rows}L) div {n_shards}L")).alias("slot"),
    )


def write_shards(rows: DataFrame, path: str, n_shards: int, **options) -> None:
    """Shuffle and write: one folder per shard, rows in the order of their slots within each file."""
    placed = shuffle_into_shards(rows, n_shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
