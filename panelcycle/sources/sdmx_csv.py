"""Statistical CSV files (one row per period) to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcycle.functions.periods import looks_dated, period_start
from panelcycle.schema import LONG_COLUMNS

PERIOD, VALUE = "TIME_PERIOD", "OBS_VALUE"
SERIES_ID_LENGTH = 64

# Spellings of a missing number.
MISSING_MARKS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_sdmx_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings. Types are never inferred: a file of plain years stays text.

    Files under one path share a header; give ``columns`` to skip reading it. ``file`` holds the
    landed file's path.
    """
    # a file whose header differs from the schema fails the job instead of being read by position
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if columns is not None:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"))


def series_key_of(url: Column) -> Column:
    """Last path segment before any query string."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def series_id_of(url: Column) -> Column:
    """The series key as it is stamped on rows: at most 64 characters."""
    return F.left(series_key_of(url), F.lit(SERIES_ID_LENGTH))


def parse_sdmx(raw: DataFrame, entity: Column | str = "entity", indicator: Column | str = "indicator",
               source: Column | str = "source", series_id: Column | str = "series_id") -> DataFrame:
    """Long rows plus ``error``.

    Missing values and unknown period forms are skipped; a period or number that cannot be read
    leaves its message in ``error``. A frame without the two required columns yields no rows.
    """
    named = {"entity": entity, "indicator": indicator, "source": source, "series_id": series_id}
    keys = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in named.items()]
    if PERIOD not in raw.columns or VALUE not in raw.columns:
        return raw.select(*keys).where(F.lit(False)).select(
            "entity", "indicator", F.lit(None).cast("date").alias("date"),
            F.lit(None).cast("double").alias("value"), "source", "series_id",
            F.lit(None).cast("string").alias("error"),
        )
    period, text = F.col(PERIOD), F.trim(F.col(VALUE))
    usable = text.isNotNull() & ~text.isin(list(MISSING_MARKS)) & looks_dated(period)
    rows = raw.where(usable).select(
        *keys, period.alias("_period"), text.alias("_text"),
        period_start(period).alias("date"), text.try_cast("double").alias("value"),
    )
    fault = F.when(F.col("date").isNull(), F.concat(F.lit("period out of range: "), "_period")).when(
        F.col("value").isNull(), F.concat(F.lit("not a number: "), "_text")
    )
    return rows.select(*LONG_COLUMNS, fault.alias("error"))


def load_sdmx_csv(spark: SparkSession, path: str, specs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Parse landed files named after their series key, stamped from the spec with that whole key.

    Rows of a file without a spec come out with the error ``no spec for this file`` and no stamp.
    """
    raw = read_sdmx_csv(spark, path, columns)
    landed = raw.withColumn("_key", series_key_of(F.regexp_replace("file", r"\.csv(\.gz)?$", "")))
    wanted = specs.select(F.col("series_id").alias("_spec"), "entity", "indicator", "source")
    stamped = landed.join(wanted, F.col("_key") == F.col("_spec"), "left").withColumn(
        "series_id", F.left("_key", F.lit(SERIES_ID_LENGTH))
    )
    parsed = parse_sdmx(stamped.where(F.col("_spec").isNotNull()))
    strays = stamped.where(F.col("_spec").isNull()).select(
        *[F.lit(None).cast(parsed.schema[c].dataType).alias(c) if c != "series_id" else F.col(c) for c in LONG_COLUMNS],
        F.lit("no spec for this file").alias("error"),
    ).distinct()
    return parsed.unionByName(strays)
