"""Freshness checks of provider series against their catalogue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.functions.text import joined
from panelcycle.schema import present

# Ages in days, and the id parts of series that are growth rates already.
VERY_STALE_DAYS = 730
STALE_DAYS = 365
ALREADY_GROWTH_MARKS = ("657", "659")


def newest_per_series(raw: DataFrame, today: dt.date, series: str = "series_id", date: str = "date",
                      value: str = "value") -> DataFrame:
    """Latest date, age in days and latest value of each raw series."""
    return (
        raw.where(present(F.col(value)))
        .groupBy(series)
        .agg(F.max(date).alias("latest"), F.max_by(value, date).alias("sample"))
        .withColumn("age_days", F.date_diff(F.lit(today), F.col("latest")))
    )


def freshness(specs: DataFrame, raw: DataFrame, today: dt.date, series: str = "series_id") -> DataFrame:
    """Every spec with its newest date, age and notes; a series without rows is ``EMPTY``."""
    aged = specs.join(newest_per_series(raw, today, series), series, "left")
    age = F.col("age_days")
    double_growth = F.col(series).contains(ALREADY_GROWTH_MARKS[0])
    for mark in ALREADY_GROWTH_MARKS[1:]:
        double_growth = double_growth | F.col(series).contains(mark)
    # The texts of the notes, "EMPTY" and "ok" below included.
    notes = joined(
        [
            F.when(age > VERY_STALE_DAYS, "STALE >2y").when(age > STALE_DAYS, "stale >1y"),
            F.when((F.col("transform") == "yoy") & double_growth, "BUG: 657/659 already YoY"),
        ],
        "; ",
    )
    note = F.when(F.col("latest").isNull(), "EMPTY").when(notes == "", "ok").otherwise(notes)
    return aged.withColumn("notes", note)


def candidates(raw: DataFrame, today: dt.date, ids: DataFrame | None = None, series: str = "series_id") -> DataFrame:
    """Latest date, age and sample per candidate id, each id once."""
    wanted = raw if ids is None else raw.join(ids.select(series).distinct(), series, "left_semi")
    return newest_per_series(wanted, today, series)


def fresh_candidates(raw: DataFrame, today: dt.date, ids: DataFrame | None = None, series: str = "series_id") -> DataFrame:
    """Candidates observed within the last year."""
    return candidates(raw, today, ids, series).where(F.col("age_days") < STALE_DAYS)
