"""Entity and world views: classifications, tilts and the full basket."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcycle.catalog.entities import HOME_ENTITY_BY_CURRENCY
from panelcycle.catalog.tilts import DEFAULT_CAUTION, LONG_TERM_TILTS, SHORT_TERM_TILTS
from panelcycle.functions.scalars import DERIVED_FEATURES
from panelcycle.operators.membership import flag_presence
from panelcycle.operators.snapshot import feature_snapshots
from panelcycle.operators.rules import LONG_TERM, SHORT_TERM, RuleSet
from panelcycle.operators.tilts import TiltTable, asset_tilts
from panelcycle.plans.classify import classify
from panelcycle.schema import PANEL, PanelColumns


def home_real_rates(panel: DataFrame, grid: Sequence[dt.date], home_entities: Sequence[str],
                    cols: PanelColumns = PANEL, **options) -> DataFrame:
    """Real rate of the listed home entities on every grid date.

    The entity filter reaches the scan; the result holds at most one row per listed entity and
    grid date, both of which come from the caller.
    """
    own = panel.where(cols.entity_in(home_entities))
    rates = feature_snapshots(own, grid, indicators=("yield_10y", "cpi_yoy"), lagged={}, cols=cols, **options)
    (home,) = cols.entity_key
    return rates.select(F.col(home).alias("_home"), "as_of", F.expr(DERIVED_FEATURES["real_rate_10y"]).alias("home_real_rate"))


def entity_views(
    panel: DataFrame,
    grid: Sequence[dt.date],
    home_currency: str = "USD",
    homes: Mapping[str, str] = HOME_ENTITY_BY_CURRENCY,
    priority: Sequence[str] = (),
    one_row_per_day: bool = False,
    short_term: RuleSet = SHORT_TERM,
    long_term: RuleSet = LONG_TERM,
    short_table: TiltTable = SHORT_TERM_TILTS,
    long_table: TiltTable = LONG_TERM_TILTS,
    with_reasons: bool = True,
    cols: PanelColumns = PANEL,
    **options,
) -> DataFrame:
    """Both classifications and the tilts of every entity, seen from one home currency.

    An entity that is itself the home sees no gap. A currency without a home entity, and USD,
    add no overlay. The rule sets and their tilt tables may be the user's own.
    """
    classified = classify(panel, grid, priority=priority, one_row_per_day=one_row_per_day, with_reasons=with_reasons,
                          short_term=short_term, long_term=long_term, cols=cols, **options)
    tilting = {"short_table": short_table, "long_table": long_table, "with_reasons": with_reasons,
               "short_order": short_term.voting_order, "long_order": long_term.voting_order}
    home = homes.get(home_currency)
    if home_currency == "USD" or home is None:
        return asset_tilts(classified, home_currency, **tilting)
    rates = home_real_rates(panel, grid, [home], cols, priority=priority, one_row_per_day=one_row_per_day)
    # one row per grid date
    joined = classified.join(F.broadcast(rates.drop("_home")), "as_of", "left")
    return asset_tilts(joined, home_currency, F.col("home_real_rate"), **tilting)


def viewer_views(
    panel: DataFrame,
    grid: Sequence[dt.date],
    currencies: Sequence[str],
    homes: Mapping[str, str] = HOME_ENTITY_BY_CURRENCY,
    priority: Sequence[str] = (),
    one_row_per_day: bool = False,
    short_term: RuleSet = SHORT_TERM,
    long_term: RuleSet = LONG_TERM,
    short_table: TiltTable = SHORT_TERM_TILTS,
    long_table: TiltTable = LONG_TERM_TILTS,
    with_reasons: bool = True,
    cols: PanelColumns = PANEL,
    **options,
) -> DataFrame:
    """The views of ``entity_views`` from many home currencies at once: one row per entity, date and currency.

    Entities are classified once. A currency is a row of the viewer's side, with its home entity, and
    the homes' real rates are joined by (home, date). USD and currencies without a home add no overlay,
    and a home sees no gap to itself.
    """
    classified = classify(panel, grid, priority=priority, one_row_per_day=one_row_per_day, with_reasons=with_reasons,
                          short_term=short_term, long_term=long_term, cols=cols, **options)
    asked = list(dict.fromkeys(currencies))
    known = {c: homes[c] for c in asked if c in homes and c != "USD"}
    kind = cols.entity_key[0]
    viewers = F.array(*[
        F.struct(F.lit(c).alias("viewer_currency"), F.lit(known.get(c)).cast(panel.schema[kind].dataType).alias("_home")) for c in asked
    ])
    viewed = classified.select("*", F.inline(viewers))
    rates = home_real_rates(panel, grid, sorted(set(known.values())), cols, priority=priority, one_row_per_day=one_row_per_day)
    joined = viewed.join(rates, ["_home", "as_of"], "left").drop("_home")
    tilted = asset_tilts(joined, F.col("viewer_currency"), F.col("home_real_rate"), short_table=short_table, long_table=long_table,
                         with_reasons=with_reasons, short_order=short_term.voting_order, long_order=long_term.voting_order)
    return tilted.drop("viewer_currency")


def world_view(panel: DataFrame, basket: DataFrame, as_of: dt.date, cols: PanelColumns = PANEL, **options) -> DataFrame:
    """One row per basket entity, with or without data.

    ``basket`` is the entity dimension. Entities without any row are filled with the neutral
    answer; entities with rows but no verdict keep their own.
    """
    seen = flag_presence(basket, panel, cols.entity, cols)
    views = entity_views(panel, [as_of], cols=cols, **{"with_reasons": False, **options}).select(
        cols.entity, "lt_phase", "lt_label", "st_stage", "st_label", "caution_level",
        F.col("total_credit_pct_gdp").alias("total_debt_pct_gdp"), "debt_service_ratio", "cpi_yoy", "real_rate_10y",
    )
    joined = seen.join(views, cols.entity, "left")
    neutral = {"lt_phase": 0, "st_stage": 0, "caution_level": DEFAULT_CAUTION}
    filled = {name: F.coalesce(F.col(name), F.lit(value)) for name, value in neutral.items()}
    empty = F.when(F.col("has_data"), F.lit("Transition (insufficient data)")).otherwise("No data")
    filled |= {name: F.coalesce(F.col(name), empty) for name in ("lt_label", "st_label")}
    return joined.withColumns(filled)

