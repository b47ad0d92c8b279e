"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def keyed(column: str) -> Column:
    """A string as a join key: null is a value of its own, apart from the empty string."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit("null"))


def array_literal(values: list, kind: str) -> Column:
    """A long constant array: one string that the optimizer turns into a literal, not a tree of constants."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def join_by_weight(rows: DataFrame, small: DataFrame, keys: list[str], heavy: Column) -> DataFrame:
    """Inner join of ``rows`` with a table that has one row per key, where a key may hold any share of the rows.

    ``heavy`` marks the keys of a thousandth of the rows or more. There are a thousand of them at most, so
    they are broadcast and their rows stay where they are; all other rows are shuffled. Both frames
    should be tables, as they are read twice if there is a heavy key.
    """
    hot = small.where(heavy)
    if not hot.limit(1).count():
        return rows.join(small, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.where(~heavy), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


#: Bits of one row of a filter's bitmap, and the most bits of a filter (16 MB).
BITMAP_BITS, FILTER_BITS = 32_768, 1 << 27


def with_filter(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` and a boolean column: false only if ``key``, a 64-bit hash, is none of ``keys`` (one column).

    The filter is a bitmap of 16 bits a key, so some 6 % of the other rows are true as well; more beyond ``FILTER_BITS``.
    It is broadcast, the rows stay where they are. ``keys`` should be a table, as it is read twice.
    """
    of = keys.columns[0]
    bits = BITMAP_BITS
    while bits < min(16 * keys.agg(F.approx_count_distinct(of)).first()[0], FILTER_BITS):
        bits *= 2
    place = F.pmod(F.col(of), F.lit(bits))
    bitmap = keys.select(place.alias("at")).groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("_row")).agg(
        F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("_bits")
    )
    at = F.pmod(F.col(key), F.lit(bits))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at % BITMAP_BITS / 8) + 1, 1)), 16, 10).cast("int")
    told = F.coalesce(F.bit_get(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = rows.join(F.broadcast(bitmap), F.floor(at / BITMAP_BITS) == F.col("_row"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], told.alias(name))
