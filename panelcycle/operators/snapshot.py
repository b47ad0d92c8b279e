"""Feature snapshots: one wide row per entity and as-of date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.catalog.indicators import (
    ALL_INDICATORS,
    LAGGED_FEATURES,
    LONG_TERM_INDICATORS,
    SHORT_TERM_INDICATORS,
)
from panelcycle.functions.scalars import DERIVED_FEATURES
from panelcycle.operators.asof import answers_on_grid, daily_rows
from panelcycle.operators.vintages import vintage_answers
from panelcycle.schema import PANEL, PanelColumns


# Indicator name of the marker rows below; it is no one's indicator.
_MARKER = ""


def _markers(entities: DataFrame, first: dt.date, cols: PanelColumns) -> DataFrame:
    """One row per entity that answers every grid date and carries no indicator."""
    return entities.select(
        *cols.entity_key, F.lit(_MARKER).alias(cols.indicator),
        F.lit(first).alias(cols.date), F.lit(0.0).alias(cols.value),
    ).distinct()


def _on_earlier_dates(snapshots: DataFrame, grid: Sequence[dt.date], cols: PanelColumns) -> DataFrame:
    """Add empty rows on the grid dates before an entity's first one. An entity has a row per date at most."""
    first = F.row_number().over(Window.partitionBy(*cols.entity_key).orderBy("as_of")) == 1
    earlier = F.filter(F.array(*[F.lit(d) for d in grid]), lambda d: d < F.col("as_of"))
    dates = F.when(first, F.array_append(earlier, F.col("as_of"))).otherwise(F.array("as_of"))
    spread = snapshots.withColumn("_dates", dates).withColumn("_at", F.explode_outer("_dates"))
    values = [c for c in snapshots.columns if c not in (*cols.entity_key, "as_of")]
    own = F.col("_at") == F.col("as_of")
    return spread.select(*cols.entity_key, F.col("_at").alias("as_of"), *[F.when(own, F.col(c)).alias(c) for c in values])


def feature_snapshots(
    panel: DataFrame,
    grid: Sequence[dt.date],
    entities: DataFrame | None = None,
    indicators: Sequence[str] = ALL_INDICATORS,
    lagged: Mapping[str, tuple[str, int]] = LAGGED_FEATURES,
    priority: Sequence[str] = (),
    one_row_per_day: bool = False,
    every_date: bool = False,
    known_by: Sequence[dt.date | dt.datetime] | None = None,
    colocated: bool = False,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """As-of values, lagged values and observation dates of all indicators, side by side.

    With ``entities`` every listed entity gets a row on every date, data or not; without it the
    entities are those of the panel, from their first observation on, or on all dates with
    ``every_date``, if they have an observation by the last one. The indicator list is fixed, so widening needs no pass to
    discover columns.

    With ``known_by`` (one load time per grid date, never falling) the panel is a log of revisions,
    and a date's row holds what was loaded by its load time; see ``operators.vintages``.

    The canonical rows are shuffled once, by entity. Lags, as-of picks, widening and a later join
    on the entity all work inside that partitioning. An entity holds at most one row per listed
    indicator and calendar day, so no entity can outgrow a task. ``colocated`` leaves that shuffle
    out, for panels that are stored by entity already (``sources.tables.save_bucketed``).
    """
    wanted = panel.where(F.col(cols.indicator).isin(list(indicators)))
    lag_days = sorted({days for name, days in lagged.values() if name in indicators})
    if known_by is not None:
        marked = None if entities is None else _markers(entities, grid[0], cols)
        answered = vintage_answers(wanted, grid, known_by, lag_days, priority, marked, cols)
    else:
        daily = daily_rows(wanted, grid[-1], priority, one_row_per_day, cols)
        if entities is not None:
            daily = daily.unionByName(_markers(entities, grid[0], cols))
        answered = answers_on_grid(daily if colocated else daily.repartition(*cols.entity_key), grid, lag_days, cols)

    def pick(indicator: str, column: str, name: str):
        return F.expr(f"max({column}) FILTER (WHERE `{cols.indicator}` = '{indicator}') AS `{name}`")

    aggregates = []
    for name in indicators:
        aggregates += [pick(name, "value", name), pick(name, "observed_on", f"{name}_date")]
    for feature, (name, days) in lagged.items():
        if name in indicators:
            aggregates.append(pick(name, f"lag_{days}d", feature))
    found = answered.groupBy(*cols.entity_key, "as_of").agg(*aggregates)
    return _on_earlier_dates(found, grid, cols) if every_date and entities is None else found


def with_derived_features(snapshots: DataFrame) -> DataFrame:
    """Add the difference features and the newest date used by each classifier."""
    short_dates = [f"{i}_date" for i in SHORT_TERM_INDICATORS]
    long_dates = [f"{i}_date" for i in (*LONG_TERM_INDICATORS, "yield_10y", "cpi_yoy")]
    return snapshots.selectExpr(
        "*",
        *[f"{expression} AS {name}" for name, expression in DERIVED_FEATURES.items()],
        f"greatest({', '.join(short_dates)}) AS st_data_date",
        f"greatest({', '.join(long_dates)}) AS lt_data_date",
    )


def indicator_dates(indicators: Sequence[str] = ALL_INDICATORS):
    """Map of indicator -> observation date, holding only the indicators that were found."""
    pairs = F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"{i}_date").alias("value")) for i in indicators])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
