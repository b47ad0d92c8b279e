"""Raw provider series, ``(series_id, date, value)``, to observations by their spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.operators.series import ROWS_PER_YEAR, year_over_year
from panelcycle.schema import LONG_COLUMNS, present

SOURCE = "FRED"


def faulty_specs(specs: DataFrame) -> DataFrame:
    """Specs that cannot be carried out, with the reason; no data is needed to tell."""
    transform, frequency = F.col("transform"), F.col("frequency")
    fault = F.when(~transform.isin("raw", "yoy"), F.concat(F.lit("unknown transform: "), transform)).when(
        (transform == "yoy") & ~frequency.isin(list(ROWS_PER_YEAR)),
        F.concat(F.lit("no yearly step for frequency "), frequency),
    )
    return specs.withColumn("error", fault).where(F.col("error").isNotNull())


def land_series(raw: DataFrame, specs: DataFrame, source: str = SOURCE) -> DataFrame:
    """Long rows of all sound specs: missing values dropped, growth applied where asked.

    Level series need no neighbour rows and are not shuffled; only growth series go through the
    window.
    """
    columns = ["series_id", "entity", "indicator", "frequency"]
    clean = raw.where(present(F.col("value"))).select("series_id", F.to_date("date").alias("date"), "value")
    levels = clean.join(specs.where(F.col("transform") == "raw").select(*columns), "series_id")
    growing = specs.where((F.col("transform") == "yoy") & F.col("frequency").isin(list(ROWS_PER_YEAR)))
    grown = year_over_year(
        clean.join(growing.select(*columns), "series_id"),
        F.col("frequency"), ("entity", "indicator", "series_id"),
    )
    return levels.unionByName(grown).withColumn("source", F.lit(source)).select(*LONG_COLUMNS)
