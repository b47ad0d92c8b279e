"""Inequality JSON, ``[meta, [observation, ...]]``, to observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcycle.schema import LONG_COLUMNS

# The stamp of the series.
STAMP = {"indicator": "gini", "source": "WORLD_BANK", "series_id": "SI.POV.GINI"}


def read_worldbank_json(spark: SparkSession, path: str) -> DataFrame:
    """One payload per landed file; the provider pages its answers, so a payload stays small."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("file"))


def parse_worldbank_json(payloads: DataFrame, payload: str = "payload", entity: str = "entity") -> DataFrame:
    """Long rows dated Dec 31 plus ``error``.

    NULL values are skipped. A payload of another shape, such as ``[{message}]``, has no rows;
    one that is not JSON at all, or holds an unreadable year or number, is reported.
    """
    parsed = F.try_parse_json(F.col(payload))
    seen = F.try_variant_get(parsed, "$[1]", "array<struct<date:string,value:string>>")
    broken = F.when(parsed.isNull(), F.lit("payload is not JSON"))
    rows = payloads.select(F.col(entity).alias("entity"), broken.alias("_broken"), F.explode_outer(seen).alias("_o"))
    text = F.col("_o.value")
    year = F.trim(F.col("_o.date")).try_cast("int")
    number = text.try_cast("double")
    fault = F.coalesce(
        F.col("_broken"),
        F.when(text.isNotNull() & ~F.coalesce(year.between(1, 9999), F.lit(False)),
               F.concat(F.lit("not a year: "), F.coalesce(F.col("_o.date"), F.lit("NULL")))),
        F.when(text.isNotNull() & number.isNull(), F.concat(F.lit("not a number: "), text)),
    )
    stamped = rows.select(
        "entity",
        *[F.lit(v).alias(k) for k, v in STAMP.items()],
        F.when(year.between(1, 9999), F.make_date(year, F.lit(12), F.lit(31))).alias("date"),
        number.alias("value"),
        fault.alias("error"),
    )
    usable = F.col("value").isNotNull() | F.col("error").isNotNull()
    return stamped.where(usable).select(*LONG_COLUMNS, "error")
