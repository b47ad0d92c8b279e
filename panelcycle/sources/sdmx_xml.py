"""Reserve-share XML to observations, by attribute pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcycle.functions.periods import period_end
from panelcycle.schema import LONG_COLUMNS

# The pair pattern, and the stamp of the world-wide series.
PAIR = r'TIME_PERIOD="([^"]+)"\s+OBS_VALUE="([^"]+)"'
RESERVE_STAMP = {
    "entity": "WLD",
    "indicator": "cofer_usd_share",
    "source": "IMF_COFER",
    "series_id": "G001.AFXRA.CI_USD.SHRO_PT.Q",
}


def read_sdmx_xml(spark: SparkSession, path: str) -> DataFrame:
    """Payload text cut at every ``>``, so one large file is read by many tasks.

    A pair never spans a ``>``: between its two attributes there is only white space, and a value
    containing one is not a number or period anyway.
    """
    return spark.read.option("lineSep", ">").text(path).select(F.col("value").alias("payload"))


def parse_sdmx_xml(payloads: DataFrame, payload: str = "payload", stamp: dict[str, str] | None = None) -> DataFrame:
    """Long rows, stamped on the last day of the period; unreadable periods and numbers are skipped.

    ``stamp`` maps the four key columns to constants; a key left out is taken from the input.
    """
    stamp = RESERVE_STAMP if stamp is None else stamp
    keys = ("entity", "indicator", "source", "series_id")
    pairs = payloads.select(
        *[F.lit(stamp[k]).alias(k) if k in stamp else F.col(k) for k in keys],
        F.explode(F.regexp_extract_all(F.col(payload), F.lit(PAIR), F.lit(0))).alias("_pair"),
    )
    rows = pairs.select(
        *keys,
        period_end(F.regexp_extract("_pair", PAIR, 1)).alias("date"),
        F.trim(F.regexp_extract("_pair", PAIR, 2)).try_cast("double").alias("value"),
    )
    return rows.where(F.col("date").isNotNull() & F.col("value").isNotNull()).select(*LONG_COLUMNS)
