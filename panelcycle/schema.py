"""The long observation table every operator reads and writes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PanelColumns:
    """Column names of a panel; operators take one so any star schema can be used as is.

    An entity may be several columns, as in ``PanelColumns(entity=("customer", "part", "flag"))``.
    """

    entity: str | tuple[str, ...] = "entity"
    indicator: str = "indicator"
    date: str = "date"
    value: str = "value"
    source: str = "source"
    series_id: str = "series_id"
    fetched_at: str = "fetched_at"

    @property
    def entity_key(self) -> list[str]:
        return [self.entity] if isinstance(self.entity, str) else list(self.entity)

    @property
    def series_key(self) -> list[str]:
        return [*self.entity_key, self.indicator]

    @property
    def source_series_key(self) -> list[str]:
        return [*self.series_key, self.source]

    @property
    def natural_key(self) -> list[str]:
        return [*self.series_key, self.date, self.source]

    def entity_in(self, names: Sequence) -> Column:
        """Whether a row's entity is listed; entities of several columns are listed as tuples."""
        keys = self.entity_key
        if len(keys) == 1:
            return F.col(keys[0]).isin(list(names))
        listed = [reduce(and_, [F.col(k) == F.lit(v) for k, v in zip(keys, name, strict=True)]) for name in names]
        return reduce(or_, listed, F.lit(False))


PANEL = PanelColumns()

OBSERVATION_SCHEMA = T.StructType(
    [
        T.StructField(PANEL.entity, T.StringType(), False),
        T.StructField(PANEL.indicator, T.StringType(), False),
        T.StructField(PANEL.date, T.DateType(), False),
        T.StructField(PANEL.value, T.DoubleType(), False),
        T.StructField(PANEL.source, T.StringType(), False),
        T.StructField(PANEL.series_id, T.StringType(), False),
        T.StructField(PANEL.fetched_at, T.TimestampType(), True),
    ]
)

LONG_COLUMNS = [
    PANEL.entity,
    PANEL.indicator,
    PANEL.date,
    PANEL.value,
    PANEL.source,
    PANEL.series_id,
]


def present(value: Column) -> Column:
    """True for a usable double: neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def as_observations(df: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    """Cast a loosely typed long frame to the observation types, dropping missing values."""
    typed = df.select(
        F.col(cols.entity).cast("string").alias(PANEL.entity),
        F.col(cols.indicator).cast("string").alias(PANEL.indicator),
        F.to_date(cols.date).alias(PANEL.date),
        F.col(cols.value).cast("double").alias(PANEL.value),
        F.col(cols.source).cast("string").alias(PANEL.source),
        F.col(cols.series_id).cast("string").alias(PANEL.series_id),
    )
    return typed.where(present(F.col(PANEL.value)) & F.col(PANEL.date).isNotNull())
