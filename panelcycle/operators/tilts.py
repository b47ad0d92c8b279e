"""Asset tilts: four additive layers over a classified row.

The tilt tables hold eight assets by a handful of classes, so they become literals of the plan.
A classified row is expanded to its eight assets in place: no join, no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcycle.catalog.tilts import (
    ASSET_LABELS,
    ASSETS,
    HOME_CURRENCY_TILTS,
    LONG_TERM_TILTS,
    REAL_YIELD_TILTS,
    SHORT_TERM_TILTS,
)
from panelcycle.functions.scalars import (
    caution_level,
    direction,
    home_currency_intensity,
    real_yield_intensity,
    real_yield_regime,
)
from panelcycle.functions.text import summary_line, worded
from panelcycle.operators.rules import LONG_TERM, SHORT_TERM
from panelcycle.operators.votes import quoted

TiltTable = Mapping[int, Mapping[str, float]]

# Fixed value: contributions up to this size get no reason.
REASON_CUTOFF = 0.01


def layer_tilt(asset: str, table: TiltTable, cls: str, prefix: str, order: Sequence[int]) -> str:
    """Unweighted tilt of one asset for one cycle, as SQL.

    A class reads its table row. Class 0 blends the rows of all voting classes by their share of
    the vote weight, 0 when nothing voted.
    """
    rows = "".join(f" WHEN {cls} = {k} THEN {float(row[asset])}D" for k, row in table.items() if k and asset in row)
    parts = [f"{float(table[k][asset])}D * ({prefix}_w{k} / _{prefix}_total)" for k in order if asset in table.get(k, {})]
    blend = f" WHEN {cls} = 0 AND _{prefix}_total > 0D THEN {' + '.join(parts)}" if parts else ""
    return f"CASE{blend}{rows} ELSE 0D END" if rows or blend else "0D"


def _reasons(asset: str) -> str:
    st, lt = f"_st_{asset}", f"_lt_{asset}"
    parts = [
        (st, worded("short term %s at %.0f%%: %+.2f", "st_label", "100D * st_confidence", f"{st} * _st_conf")),
        (lt, worded("long term %s at %.0f%%: %+.2f", "lt_label", "100D * lt_confidence", f"{lt} * _lt_conf")),
    ]
    for table, column, template, values in (
        (REAL_YIELD_TILTS, "_ry", "real yield %s, %+.1f%%: %+.2f", ("real_yield_regime", "real_rate_10y")),
        (HOME_CURRENCY_TILTS, "_fx", "%s view, real rates %+.1fpp apart: %+.2f", ("home_currency", "_gap")),
    ):
        if asset in table:
            amount = f"{float(table[asset])}D * {column}"
            parts.append((amount, worded(template, *values, amount)))
    shown = ", ".join(f"CASE WHEN abs({amount}) > {REASON_CUTOFF}D THEN {words} END" for amount, words in parts)
    return f"concat_ws(' · ', {shown})"


def asset_tilts(
    classified: DataFrame,
    home_currency: Column | str = "USD",
    home_real_rate: Column | None = None,
    short_table: TiltTable = SHORT_TERM_TILTS,
    long_table: TiltTable = LONG_TERM_TILTS,
    with_reasons: bool = True,
    short_order: Sequence[int] = SHORT_TERM.voting_order,
    long_order: Sequence[int] = LONG_TERM.voting_order,
) -> DataFrame:
    """Add a ``tilts`` array with one struct per asset, in display order, and the header columns.

    ``classified`` carries both cycles' class, label, confidence and class weights, and
    ``real_rate_10y``; the orders are their rule sets' voting orders. Confidences scale the two cycle layers; the overlays speak for themselves.
    """
    currency = F.lit(home_currency) if isinstance(home_currency, str) else home_currency
    target = F.col("real_rate_10y")
    home = F.lit(None).cast("double") if home_real_rate is None else home_real_rate
    staged = classified.withColumns(
        {
            "_st_total": F.expr(" + ".join(f"st_w{k}" for k in short_order)),
            "_lt_total": F.expr(" + ".join(f"lt_w{k}" for k in long_order)),
            "_st_conf": F.expr("greatest(st_confidence, 0D)"),
            "_lt_conf": F.expr("greatest(lt_confidence, 0D)"),
            "_ry": real_yield_intensity(target),
            "_fx": home_currency_intensity(currency, home, target),
            "_gap": home - target,
            "home_currency": currency,
            "real_yield_regime": real_yield_regime(target),
            "caution_level": caution_level(F.col("lt_phase")),
        }
    )
    layers = [f"{layer_tilt(a, short_table, 'st_stage', 'st', short_order)} AS _st_{a}" for a in ASSETS]
    layers += [f"{layer_tilt(a, long_table, 'lt_phase', 'lt', long_order)} AS _lt_{a}" for a in ASSETS]
    structs = []
    for position, asset in enumerate(ASSETS):
        total = (
            f"_st_{asset} * _st_conf + _lt_{asset} * _lt_conf + {REAL_YIELD_TILTS.get(asset, 0.0)}D * _ry"
            f" + {HOME_CURRENCY_TILTS.get(asset, 0.0)}D * _fx"
        )
        fields = f"'position', {position}, 'asset', '{asset}', 'label', {quoted(ASSET_LABELS[asset])}, 'tilt', {total}"
        if with_reasons:
            fields += f", 'reasons', {_reasons(asset)}"
        structs.append(f"named_struct({fields})")
    tilted = staged.selectExpr("*", *layers).selectExpr("*", f"array({', '.join(structs)}) AS tilts")
    scratch = [f"_{p}_{a}" for p in ("st", "lt") for a in ASSETS]
    scratch += ["_st_total", "_lt_total", "_st_conf", "_lt_conf", "_ry", "_fx", "_gap"]
    return tilted.drop(*scratch).withColumn(
        "summary", summary_line(F.col("st_label"), F.col("lt_label"), F.col("caution_level"))
    )


def explode_tilts(tilted: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long form: one row per asset, with the arrow bucket.

    The outer form of the generator is deliberate. For the inner one Spark infers a "not empty"
    filter and pushes it below every projection, copying the whole tilt arithmetic into it.
    """
    return tilted.selectExpr(*keep, "inline_outer(tilts)").withColumn("direction", direction(F.col("tilt")))


def top_tilts(tilted: DataFrame, keep: Sequence[str], n: int = 3) -> DataFrame:
    """The n largest tilts by magnitude, display order breaking ties; n = 8 ranks them all.

    The eight tilts of a row sit in one array, so ranking them needs no window.
    """
    ranked = f"slice(sort_array(transform(tilts, t -> struct(-abs(t.tilt), t.position, t))), 1, {int(n)})"
    best = tilted.selectExpr(*keep, f"posexplode_outer({ranked}) AS (_at, _best)")
    return best.selectExpr(*keep, "_at + 1 AS rank", "_best.t.*").withColumn("direction", direction(F.col("tilt")))


def rank_long_tilts(long_tilts: DataFrame, keys: Sequence[str], n: int = 3) -> DataFrame:
    """Top n of an already long tilt table; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy(*keys).orderBy(F.abs("tilt").desc(), "position")
    return long_tilts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
