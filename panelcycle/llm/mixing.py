"""Mixing sources to target weights by capped water-filling.

Each source wants a share of the budget by its weight, but no source may be repeated more than
``max_epochs`` times. Sources whose share exceeds that are clamped and their excess goes to the
others in proportion to weight, until none is above. The state of this is one number, the water
level (target words per unit of weight): a source's target is the smaller of its cap and level x
weight. Each round is one aggregation over the table of sources, so the driver sees three numbers.

A source's target over its size is a number of epochs: every document is taken the whole number of
times, and a seeded part of the documents once more, chosen so that the words add up to the
fraction. The choice needs no ordering of a source: documents fall into hash buckets, the sums per
bucket name the bucket in which the fraction is reached, and only that bucket is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.llm.tables import fresh_name, keyed, word_count
from panelcycle.session import materialize

#: Hex digits of the seeded hash that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, .. cycle, repeating, over the sources by code point, null last.

    One row per source goes through one ordering; documents do not.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    return sources.withColumn("weight", ((place - 1) % cycle + 1).cast("double"))


def water_level(sources: DataFrame, max_epochs: int) -> float:
    """Words per unit of weight at which capped shares use up the budget (all words).

    ``sources`` has size and weight. The level only rises from round to round, hence the rounds end.
    """
    cap = F.col("size") * max_epochs
    level = -1.0
    while True:
        clamped = cap < F.lit(level) * F.col("weight")
        found = sources.agg(
            F.sum("size").alias("budget"),
            F.sum(F.when(clamped, cap).otherwise(0)).alias("used"),
            F.sum(F.when(~clamped, F.col("weight")).otherwise(0)).alias("free"),
        ).first()
        if not found.budget or not found.free:
            return max(level, 0.0)
        raised = (found.budget - found.used) / found.free
        if raised <= level:
            return level
        level = raised


def _copies_taken(before: Column, words: Column, copies: Column, wanted: Column) -> Column:
    """How many of equal rows go into a fraction, each when more than half of it fits behind those before it."""

    def fits(copy: Column) -> Column:
        return before + copy * words - words / 2.0 < wanted

    about = F.ceil((wanted - before) / F.greatest(words, F.lit(1)) + 0.5) - 1
    exact = F.when(fits(about + 1), about + 1).when(fits(about), about).otherwise(about - 1)
    some = F.when(words > 0, exact).otherwise(F.when(before < wanted, copies).otherwise(0))
    return F.greatest(F.lit(0), F.least(some, copies)).cast("long")


def _numbered(rows: DataFrame, key: str, draw: str, copy: str) -> DataFrame:
    """Equal rows (those of one key) counted from 1; dealt over many tasks first, which count by themselves."""
    salt = fresh_name(rows, "_salt")
    dealt = materialize(rows.withColumn(salt, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024))), "mix-copies")
    sizes = dealt.groupBy(F.col(key).alias("_of"), F.col(salt).alias("_salted")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_of").orderBy("_salted").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(key, salt).orderBy(draw))
    joined = dealt.withColumn(copy, inside).join(starts, (F.col(key) == F.col("_of")) & (F.col(salt) == F.col("_salted")))
    return joined.withColumn(copy, F.col(copy) + F.col("_start")).drop("_of", "_salted", "_n", "_start", salt)


def mix_sources(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    identity: str = "doc_id",
    max_epochs: int = 3,
    seed: int = 17,
    weights=cyclic_weights,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, repeats and taken.

    ``weights`` takes a frame of (source, size) and adds a column weight; sources with a null or
    zero weight get nothing. A null text has no words; a null source is a source of its own; rows
    without words are repeated like others and take nothing. A row's draw is a hash of seed, identity
    and text, so null or repeated identities are drawn text by text; rows equal in both are counted,
    and as many of them as fit are taken. Empty input gives an empty result. If a name of the five
    columns is taken, that column is replaced. Reruns agree.
    """
    key, draw, size, copy = (fresh_name(docs, n) for n in ("_key", "_draw", "_size", "_copy"))
    body = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    named = F.coalesce(F.col(f"`{identity}`").cast("string"), F.lit("null"))
    drawn = docs.withColumns({
        draw: F.md5(F.concat_ws("|", F.lit(str(seed)), named, body).cast("binary")), key: keyed(source), size: word_count(F.col(f"`{text}`")),
    })
    # the choice is made on this narrow table: one row per source and draw
    groups = materialize(
        drawn.groupBy(F.col(key).alias("key"), F.col(f"`{source}`").alias("source"), F.col(draw).alias("draw")).agg(
            F.max(size).alias("words"), F.count(F.lit(1)).alias("copies")
        ).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)),
        "mix-draws",
    )
    per_bucket = materialize(groups.groupBy("key", "source", "bucket").agg(F.sum(F.col("words") * F.col("copies")).alias("words")), "mix-buckets")
    sizes = per_bucket.groupBy("key", "source").agg(F.sum("words").alias("size"))
    sources = materialize(weights(sizes).withColumn("weight", F.coalesce("weight", F.lit(0.0))), "mix-sources")
    level = water_level(sources, max_epochs)
    target = F.least(F.col("size").cast("double") * max_epochs, F.lit(level) * F.col("weight"))
    targets = sources.withColumn("target", target).withColumn(
        "whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0)
    ).withColumn("wanted", F.col("target") - F.col("whole") * F.col("size"))

    # the bucket in which the fraction is reached, and the words before it; without a fraction there is none
    in_source = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = per_bucket.withColumn("through", F.sum("words").over(in_source)).join(
        targets.select("key", "wanted"), "key"
    ).where("wanted > 0 AND through > wanted")
    edge = reached.groupBy("key").agg(
        F.min("bucket").alias("edge"), F.min(F.struct("bucket", (F.col("through") - F.col("words")).alias("before"))).alias("first")
    ).select("key", "edge", F.col("first.before").alias("before"))
    targets = targets.join(edge, "key", "left")

    # only that bucket is put in order; a document goes in when more than half of it fits
    on_edge = groups.select("key", "bucket", "draw", "words", "copies").join(
        targets.select("key", F.col("edge").alias("bucket"), "before", "wanted"), ["key", "bucket"]
    )
    in_bucket = Window.partitionBy("key").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.col("words") * F.col("copies")).over(in_bucket), F.lit(0))
    filled = on_edge.withColumn("ahead", ahead).withColumn(
        "taken", _copies_taken(F.col("ahead"), F.col("words"), F.col("copies"), F.col("wanted"))
    ).where("taken > 0")
    last = filled.groupBy("key").agg(F.max(F.struct("draw", "taken", "copies")).alias("last"))
    plan = materialize(
        targets.join(last, "key", "left").select(
            F.col("key").alias("_plan_key"), F.col("size").alias("_plan_size"), F.col("target").alias("_plan_target"),
            F.col("whole").alias("_plan_whole"), F.col("edge").alias("_plan_edge"), F.col("last.draw").alias("_plan_last"),
            F.col("last.taken").alias("_plan_taken"), F.col("last.copies").alias("_plan_copies"),
        ),
        "mix-plan",
    )
    planned = drawn.join(plan, F.col(key) == F.col("_plan_key")).withColumn(copy, F.lit(0).cast("long"))
    if plan.where("_plan_taken < _plan_copies").limit(1).count():
        # equal rows of which only some are taken: they alone are counted one by one
        torn = F.coalesce((F.col(draw) == F.col("_plan_last")) & (F.col("_plan_taken") < F.col("_plan_copies")), F.lit(False))
        planned = planned.where(~torn).unionByName(_numbered(planned.where(torn).drop(copy), key, draw, copy))
    # a draw below the edge bucket is in, one inside it up to the last draw taken; no edge: the fraction takes all or nothing
    in_fraction = (F.substring(draw, 1, BUCKET_DIGITS) < F.col("_plan_edge")) | (F.col(draw) < F.col("_plan_last")) | (
        (F.col(draw) == F.col("_plan_last")) & (F.col(copy) <= F.col("_plan_taken"))
    )
    once_more = F.when(F.col("_plan_edge").isNull(), F.col("_plan_target") > F.col("_plan_whole") * F.col("_plan_size")).otherwise(
        F.coalesce(in_fraction, F.lit(False))
    )
    repeats = (F.col("_plan_whole") + once_more.cast("long")).cast("long")
    own = {"size", "source_size", "target", "repeats", "taken"}
    return planned.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own],
        F.col(size).alias("size"), F.col("_plan_size").alias("source_size"), F.col("_plan_target").alias("target"),
        repeats.alias("repeats"), (F.col(size) * repeats).alias("taken"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    mixed = mix_sources(docs, **options).where("repeats > 0")
    copies = fresh_name(mixed, "_copy")
    return mixed.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
