"""The observation table, by Spark's own writers: folders by indicator and year, or buckets by entity.

The partitioned table is for loading: a batch replaces the folders it touches, by dynamic partition
overwrite, and readers prune folders. The bucketed table is for computing: its rows lie together by
entity in the session's catalogue, so as-of lookups, snapshots and what follows them on the entity
need no shuffle of their own.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcycle.operators.upsert import merge_observations, upsert_counts
from panelcycle.schema import OBSERVATION_SCHEMA, PANEL, PanelColumns
from panelcycle.session import materialize

YEAR = "obs_year"
FOLDER = (PANEL.indicator, YEAR)
#: Up to this many touched folders become a literal filter; beyond, a semi join selects rows.
LITERAL_FOLDERS = 2_000
_STORED = T.StructType([*OBSERVATION_SCHEMA.fields, T.StructField(YEAR, T.IntegerType())])


def write_partitioned(observations: DataFrame, path: str) -> None:
    """Write whole folders (indicator, year), each in place of what it held; other folders stay.

    Rebalancing keeps a folder's rows together but splits one that is too large for a task.
    """
    (
        observations.select(*OBSERVATION_SCHEMA.names)
        .withColumn(YEAR, F.year(PANEL.date))
        .hint("rebalance", *FOLDER)
        .sortWithinPartitions(*FOLDER, PANEL.entity, PANEL.date)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FOLDER)
        .parquet(path)
    )


class ObservationTable:
    """A folder of observations, partitioned by indicator and year.

    An upsert is one job's commit: folders are written beside the table and moved in when all are
    complete. A run that fails before leaves the table as it was, and one that is repeated changes
    nothing. Two upserts at once are the caller's to avoid, as with any plain Parquet table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _rows(self) -> DataFrame:
        """The stored rows with their year; none before the first upsert."""
        try:
            return self.spark.read.schema(_STORED).parquet(self.path)
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _STORED)

    def _touched(self, batch: DataFrame) -> DataFrame:
        """Stored rows of the folders that hold a key of the batch."""
        folders = batch.select(PANEL.indicator, F.year(PANEL.date).alias(YEAR)).distinct()
        listed = folders.limit(LITERAL_FOLDERS + 1).collect()
        rows = self._rows()
        if len(listed) > LITERAL_FOLDERS:
            return rows.join(folders, list(FOLDER), "left_semi").select(*OBSERVATION_SCHEMA.names)
        # of partition columns only, so it is decided per folder before anything is read
        key = F.concat_ws("/", F.col(YEAR).cast("string"), F.col(PANEL.indicator))
        return rows.where(key.isin([f"{f[YEAR]}/{f[PANEL.indicator]}" for f in listed])).select(*OBSERVATION_SCHEMA.names)

    def read(self, indicators: Sequence[str] | None = None, until: dt.date | None = None) -> DataFrame:
        """The observations, optionally of some indicators and up to a date; both prune folders."""
        rows = self._rows()
        if indicators is not None:
            rows = rows.where(F.col(PANEL.indicator).isin(list(indicators)))
        if until is not None:
            rows = rows.where((F.col(YEAR) <= until.year) & (F.col(PANEL.date) <= F.lit(until)))
        return rows.select(*OBSERVATION_SCHEMA.names)

    def upsert(self, batch: DataFrame, arrival: str | None = None) -> DataFrame:
        """Merge a batch and return the counts per series.

        The batch and the merged rows are evaluated once each, into the checkpoint folder: the folders
        that are replaced are read before they are written, and counts and rows can not disagree.
        """
        order = F.monotonically_increasing_id() if arrival is None else F.col(arrival).cast("bigint")
        loaded = F.col(PANEL.fetched_at) if PANEL.fetched_at in batch.columns else F.current_timestamp()
        columns = [F.col(c) for c in OBSERVATION_SCHEMA.names if c != PANEL.fetched_at]
        landed = materialize(batch.select(*columns, loaded.alias(PANEL.fetched_at), order.alias("_arrival")), "table-batch")
        merged = materialize(merge_observations(self._touched(landed), landed, "_arrival"), "table-merged")
        write_partitioned(merged, self.path)
        return upsert_counts(merged.where(F.col("action") != "kept"))


def save_bucketed(panel: DataFrame, name: str, buckets: int, path: str | None = None, cols: PanelColumns = PANEL) -> DataFrame:
    """Save a panel as a table of the session's catalogue, bucketed by entity, and return it.

    Rows are dealt to the buckets before the write, so each is one file, sorted by series and date.
    ``path`` names its folder; without it the table lies in the warehouse. Readers pass
    ``colocated=True`` to ``feature_snapshots`` and ``classify``. An entity is one bucket's: a table whose
    hottest entity outgrows a task is better read unbucketed.
    """
    writer = (
        panel.repartition(buckets, *cols.entity_key)
        .write.format("parquet")
        .mode("overwrite")
        .bucketBy(buckets, *cols.entity_key)
        .sortBy(*cols.series_key, cols.date)
    )
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return panel.sparkSession.table(name)
