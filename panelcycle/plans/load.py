"""Batch load: parsed rows of many series into the observation table, with a summary per series.

A series with any faulty row is set aside as a whole and reported; the others are loaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.schema import LONG_COLUMNS, PANEL
from panelcycle.session import materialize
from panelcycle.sources.tables import ObservationTable

ERROR = "error"


def failed_series(parsed: DataFrame) -> DataFrame:
    """(entity, indicator, error) of every series with a faulty row; one message per series."""
    return (
        parsed.where(F.col(ERROR).isNotNull())
        .groupBy(*PANEL.series_key)
        .agg(F.min(ERROR).alias(ERROR), F.count(F.lit(1)).alias("faulty_rows"))
    )


def sound_rows(parsed: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Rows of the series without a fault."""
    bad = (failed_series(parsed) if failures is None else failures).select(*PANEL.series_key)
    extra = [c for c in parsed.columns if c not in LONG_COLUMNS and c != ERROR]
    # a stray row names no series, so it meets none of the faulty ones: its own error keeps it out
    good = parsed.where(F.col(ERROR).isNull())
    return good.join(bad, PANEL.series_key, "left_anti").select(*LONG_COLUMNS, *extra)


def quarantine(parsed: DataFrame) -> DataFrame:
    """The faulty rows themselves."""
    return parsed.where(F.col(ERROR).isNotNull())


def load_summary(specs: DataFrame, counts: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per requested series: rows, inserted, skipped, or its error.

    Faults that name no series (files without a spec) share one further row without a series.
    """
    asked = specs.select(*PANEL.series_key).distinct()
    joined = asked.join(counts, PANEL.series_key, "left").join(
        failures.select(*PANEL.series_key, ERROR), PANEL.series_key, "left"
    )
    filled = {n: F.when(F.col(ERROR).isNull(), F.coalesce(F.col(n), F.lit(0))) for n in ("rows", "inserted", "skipped")}
    asked_for = joined.withColumns(filled).select(*PANEL.series_key, "rows", "inserted", "skipped", ERROR)
    strays = failures.where(F.col(PANEL.entity).isNull()).select(*PANEL.series_key, ERROR)
    return asked_for.unionByName(strays, allowMissingColumns=True)


def load_batch(table: ObservationTable, parsed: DataFrame, specs: DataFrame, arrival: str | None = None,
               quarantine_path: str | None = None) -> DataFrame:
    """Upsert the sound series of a batch and summarise all requested ones.

    ``parsed`` carries ``error`` (NULL for good rows); faults known from the specs alone can be
    unioned in as rows without date and value. It is evaluated once. With ``quarantine_path`` the
    faulty rows are appended there, after the sound ones are written, so a repeated run after a
    failure adds them once.
    """
    landed = materialize(parsed, "load-parsed")
    failures = materialize(failed_series(landed), "load-failures")
    counts = table.upsert(sound_rows(landed, failures), arrival)
    if quarantine_path is not None:
        quarantine(landed).write.mode("append").parquet(quarantine_path)
    return load_summary(specs, counts, failures)


def with_spec_faults(parsed: DataFrame, faults: DataFrame) -> DataFrame:
    """Parsed rows and, as rows without date and value, the series whose specs are faulty."""
    marked = faults.select(*PANEL.series_key, ERROR)
    return parsed.unionByName(marked, allowMissingColumns=True)


def summary_by_entity(summary: DataFrame) -> DataFrame:
    """Series, failures and rows per entity, in entity order."""
    return (
        summary.groupBy(PANEL.entity)
        .agg(
            F.count(F.lit(1)).alias("n_series"),
            F.count_if(F.col(ERROR).isNotNull()).alias("n_failed"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"),
        )
        .orderBy(PANEL.entity)
    )
