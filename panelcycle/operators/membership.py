"""Presence probes, dimension enrichment and bloc membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcycle.catalog.entities import BLOC_MEMBERS, iso3_to_entity
from panelcycle.functions.scalars import lookup
from panelcycle.schema import PANEL, PanelColumns


def entities_with_data(panel: DataFrame, cols: PanelColumns = PANEL) -> DataFrame:
    return panel.select(cols.entity).distinct()


def flag_presence(dim: DataFrame, panel: DataFrame, key: str = PANEL.entity, cols: PanelColumns = PANEL) -> DataFrame:
    """Every row of the dimension with ``has_data``."""
    seen = entities_with_data(panel, cols).select(F.col(cols.entity).alias(key), F.lit(True).alias("_seen"))
    return (
        dim.join(seen, key, "left")
        .withColumn("has_data", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def available_indicators(panel: DataFrame, catalogue: Sequence[str], cols: PanelColumns = PANEL) -> DataFrame:
    """Indicators each entity has, numbered in catalogue order."""
    order = {name: i for i, name in enumerate(catalogue)}
    present = panel.where(F.col(cols.indicator).isin(list(catalogue))).select(*cols.series_key).distinct()
    return present.withColumn("position", lookup(order, F.col(cols.indicator)))


def distinct_members(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def enrich(rows: DataFrame, dim: DataFrame, code: str, dim_code: str = "entity",
           columns: Sequence[str] = ("name", "tier", "currency")) -> DataFrame:
    """Attach dimension columns by code, any case; a code outside the dimension is an error.

    The dimension is small and left to Catalyst, which broadcasts it only under its size limit.
    """
    attributes = dim.select(F.upper(dim_code).alias("_code"), *columns, F.lit(True).alias("_known"))
    joined = rows.join(attributes, F.upper(F.col(code)) == F.col("_code"), "left")
    checked: Column = F.when(F.col("_known").isNotNull(), F.col(code)).otherwise(
        F.raise_error(F.concat(F.lit("unknown entity code: "), F.coalesce(code, F.lit("NULL"))))
    )
    return joined.withColumn(code, checked).drop("_code", "_known")


def unknown_codes(rows: DataFrame, dim: DataFrame, code: str, dim_code: str = "entity") -> DataFrame:
    """Codes that the dimension does not hold."""
    known = dim.select(F.upper(dim_code).alias("_code"))
    return rows.select(F.upper(code).alias("_code")).distinct().join(known, "_code", "left_anti")


def translate_code(rows: DataFrame, dim: DataFrame, code: str, provider: str, dim_code: str = "entity") -> DataFrame:
    """Replace an entity code by a provider's code for it, as column ``provider_code``."""
    return enrich(rows, dim, code, dim_code, [provider]).withColumnRenamed(provider, "provider_code")


def expand_blocs(rows: DataFrame, iso3: str = "iso3", blocs: Mapping[str, Sequence[str]] = BLOC_MEMBERS) -> DataFrame:
    """Repeat a bloc's row for each of its members, as column ``map_iso3``; others map to themselves."""
    members = F.array(F.col(iso3))
    for bloc, names in blocs.items():
        members = F.when(F.col(iso3) == bloc, F.array(*[F.lit(n) for n in names])).otherwise(members)
    return rows.withColumn("map_iso3", F.explode(members))


def member_to_entity(iso3: Column, table: Mapping[str, str] | None = None) -> Column:
    """Basket entity of a map code: a bloc member leads to its bloc, unknown codes to NULL."""
    return lookup(table or iso3_to_entity(), iso3)
