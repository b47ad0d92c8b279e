"""Per-entity thresholds from a series' own quantiles, field by field, with defaults."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.catalog.thresholds import (
    CALIBRATION_QUANTILES,
    DEFAULT_THRESHOLDS,
    MIN_OBSERVATIONS,
    THRESHOLD_QUANTILES,
)
from panelcycle.operators.quantiles import LARGE_SERIES_ROWS, expanding_quantiles, quantile_name, series_quantiles, vintage_quantiles
from panelcycle.schema import PANEL, PanelColumns


CALIBRATED_INDICATORS = tuple(sorted({indicator for indicator, _, _ in THRESHOLD_QUANTILES.values()}))


def _assemble(quantiles: DataFrame, keys: list[str], cols: PanelColumns) -> DataFrame:
    """Quantiles per series to one row of thresholds per key."""

    # the floor only lifts a known quantile: greatest() alone would turn NULL into the floor
    def field(indicator: str, p: float, floor: float | None) -> str:
        q = quantile_name(p)
        lifted = q if floor is None else f"CASE WHEN {q} IS NOT NULL THEN greatest({q}, {floor}D) END"
        return f"max({lifted}) FILTER (WHERE `{cols.indicator}` = '{indicator}')"

    return quantiles.groupBy(*keys).agg(
        *[F.expr(f"{field(*spec)} AS {name}") for name, spec in THRESHOLD_QUANTILES.items()]
    )


def calibrated_thresholds(
    panel: DataFrame,
    min_observations: int = MIN_OBSERVATIONS,
    large_series_rows: int | None = LARGE_SERIES_ROWS,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """One row per entity over its full history; a field is NULL where its series is too short."""
    history = panel.where(F.col(cols.indicator).isin(list(CALIBRATED_INDICATORS)))
    quantiles = series_quantiles(history, CALIBRATION_QUANTILES, min_observations, cols.series_key, large_series_rows, cols)
    return _assemble(quantiles, cols.entity_key, cols)


def expanding_thresholds(
    panel: DataFrame,
    grid: Sequence[dt.date],
    min_observations: int = MIN_OBSERVATIONS,
    large_series_rows: int | None = LARGE_SERIES_ROWS,
    known_by: Sequence[dt.date | dt.datetime] | None = None,
    cols: PanelColumns = PANEL,
) -> DataFrame:
    """One row per entity and grid date, over the history up to that date; with ``known_by`` as it was loaded by then."""
    history = panel.where(F.col(cols.indicator).isin(list(CALIBRATED_INDICATORS)))
    if known_by is not None:
        quantiles = vintage_quantiles(history, grid, known_by, CALIBRATION_QUANTILES, min_observations, cols)
    else:
        quantiles = expanding_quantiles(history, grid, CALIBRATION_QUANTILES, min_observations, large_series_rows, cols)
    return _assemble(quantiles, [*cols.entity_key, "as_of"], cols)


def with_thresholds(
    rows: DataFrame,
    thresholds: DataFrame | Mapping[str, float] | None,
    on: tuple[str, ...] = (PANEL.entity,),
) -> DataFrame:
    """Attach the seven threshold columns, each falling back to its default on its own.

    A mapping sets the same explicit thresholds for every entity; None means the defaults.
    """
    if thresholds is None or isinstance(thresholds, Mapping):
        explicit = {**DEFAULT_THRESHOLDS, **(thresholds or {})}
        return rows.selectExpr("*", *[f"{float(v)}D AS {name}" for name, v in explicit.items()])
    fields = thresholds.select(*on, *DEFAULT_THRESHOLDS)
    others = [c for c in rows.columns if c not in DEFAULT_THRESHOLDS]
    return rows.join(fields, list(on), "left").selectExpr(
        *[f"`{c}`" for c in others],
        *[f"coalesce({name}, {default}D) AS {name}" for name, default in DEFAULT_THRESHOLDS.items()],
    )


def threshold_deltas(thresholds: DataFrame, entity: str = PANEL.entity) -> DataFrame:
    """Long table: entity, field, default, entity's own value and the difference."""
    rows = ", ".join(
        f"named_struct('field', '{n}', 'default_value', {d}D, 'entity_value', coalesce({n}, {d}D))"
        for n, d in DEFAULT_THRESHOLDS.items()
    )
    long = thresholds.selectExpr(f"`{entity}`", f"inline_outer(array({rows}))")
    return long.withColumn("delta", F.col("entity_value") - F.col("default_value"))
