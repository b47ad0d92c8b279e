"""Replay, tilts, and the entity and world views."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcycle.catalog.entities import BLOC_MEMBERS, entity_dim
from panelcycle.catalog.tilts import ASSETS, LONG_TERM_TILTS, QUADRANT_TILTS, SHORT_TERM_TILTS, STAGE_QUADRANTS
from panelcycle.functions import scalars
from panelcycle.operators.membership import available_indicators, enrich, expand_blocs, flag_presence, member_to_entity, translate_code, unknown_codes
from panelcycle.operators.rules import LONG_TERM, SHORT_TERM, Rule, RuleSet, case
from panelcycle.operators.tilts import asset_tilts, explode_tilts, rank_long_tilts, top_tilts
from panelcycle.plans.classify import classify
from panelcycle.plans.replay import date_grid, entities_with_a_path, replay
from panelcycle.plans.views import entity_views, viewer_views, world_view
from panelcycle.schema import PanelColumns
from tests.conftest import day


def test_date_grids():
    d = dt.date
    assert len(date_grid(d(2008, 1, 1), d(2008, 12, 31), "Q")) == 4
    assert len(date_grid(d(2007, 1, 1), d(2010, 1, 1), "q")) == 13
    assert len(date_grid(d(2020, 1, 1), d(2020, 6, 1), "M")) == 6
    assert date_grid(d(2020, 1, 31), d(2020, 12, 31), "?") == [d(2020, 1, 31), d(2020, 4, 30), d(2020, 7, 30), d(2020, 10, 30)]
    assert date_grid(d(2020, 2, 29), d(2022, 3, 1), "Y") == [d(2020, 2, 29), d(2021, 2, 28), d(2022, 2, 28)]
    assert date_grid(d(2020, 1, 2), d(2020, 1, 1), "M") == []


def _entities(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


RECESSION = [("US", "real_gdp_yoy", -0.5), ("US", "cpi_yoy", 2.0), ("US", "unemployment_rate", 5.5), ("US", "policy_rate", 4.0),
             ("US", "yield_10y", 3.5), ("US", "yield_2y", 4.0)]


@pytest.fixture(scope="module")
def recession(panel_of):
    at = day("2009-06-30")
    return panel_of([(e, i, at, v) for e, i, v in RECESSION] + [("US", "unemployment_rate", at - dt.timedelta(days=90), 4.5)])


def test_replay_does_not_leak_backwards(spark, recession):
    rows = replay(recession, day("2008-01-01"), day("2010-01-01"), "Q", entities=_entities(spark, "US", "XX")).collect()
    stage = {(r.entity, r.date): r.st_stage for r in rows}
    assert len(rows) == 18
    assert stage["US", day("2008-01-01")] == 0 and stage["US", day("2009-04-01")] == 0 and stage["US", day("2009-10-01")] == 3
    empty = [r for r in rows if r.entity == "XX"]
    assert {(r.st_label, r.lt_label, r.st_confidence) for r in empty} == {("Transition (insufficient data)",) * 2 + (0.0,)}


def test_replay_without_a_list_has_every_entity_on_every_date(panel_of):
    panel = panel_of([("A", "cpi_yoy", "2001-05-01", 1.0), ("B", "cpi_yoy", "1999-01-01", 2.0), ("LATE", "cpi_yoy", "2009-01-01", 2.0)])
    rows = replay(panel, day("2000-01-01"), day("2002-01-01"), "Y", signal_asof="none").collect()
    assert sorted((r.entity, r.date.year) for r in rows) == [(e, y) for e in "AB" for y in (2000, 2001, 2002)]
    assert {r.st_label for r in rows if r.entity == "A" and r.date.year < 2002} == {"Transition (insufficient data)"}


def test_a_users_rule_set_through_the_views(panel_of):
    """Two classes of the user's own: labels, the blend of a tie and its order follow the rule set."""
    cycle = RuleSet((Rule("b", 2, case(("cpi_yoy > 0D", 0.5)), "'b'"), Rule("a", 1, case(("cpi_yoy > 5D", 0.4)), "'a'")), {0: "Open", 1: "One", 2: "Two"})
    assert (cycle.classes, cycle.voting_order) == ((1, 2), (2, 1))
    panel = panel_of([("X", "cpi_yoy", "2000-01-01", 1.0), ("Y", "cpi_yoy", "2000-01-01", 6.0)])
    views = entity_views(panel, [day("2000-06-01")], signal_asof="none", short_term=cycle, short_table={1: {"gold": 1.0}, 2: {"gold": -1.0}})
    rows = {r.entity: r for r in views.collect()}
    assert (rows["X"].st_stage, rows["X"].st_label) == (2, "Two")
    assert (rows["Y"].st_stage, rows["Y"].st_label) == (0, "Open (Two ↔ One)")
    gold = {e: next(t.tilt for t in r.tilts if t.asset == "gold") for e, r in rows.items()}
    assert gold["X"] == pytest.approx(-0.5 / 1.5) and gold["Y"] == pytest.approx((-0.5 + 0.4) / 0.9 * 0.5 / 1.9)


def test_voting_orders_of_the_fixed_rule_sets():
    assert SHORT_TERM.voting_order == (3, 2, 4, 1) and SHORT_TERM.classes == (1, 2, 3, 4)
    assert LONG_TERM.voting_order == LONG_TERM.classes == (1, 2, 3, 4, 5, 6)


def test_replay_at_one_date_is_a_classification(spark, recession):
    at = day("2009-10-01")
    once = classify(recession, [at]).select("st_stage", "st_label", "st_confidence", "lt_phase").first()
    walked = [r for r in replay(recession, day("2009-01-01"), at, "Q").collect() if r.date == at][0]
    assert (once.st_stage, once.st_label, once.st_confidence, once.lt_phase) == (walked.st_stage, walked.st_label, walked.st_confidence, walked.lt_phase)


def test_publication_lag_delays_the_verdict(recession):
    rows = replay(recession, day("2009-07-01"), day("2010-01-01"), "Q", publication_lag_days=120).collect()
    assert {r.date: r.st_stage for r in rows} == {day("2009-07-01"): 0, day("2009-10-01"): 0, day("2010-01-01"): 3}


def test_path_gate(spark):
    frame = spark.createDataFrame([("A", 1), ("A", 1), ("B", 1), ("B", 2)], "entity string, lt_phase int")
    assert [(r.entity, r.n_phases) for r in entities_with_a_path(frame).collect()] == [("B", 2)]


# ---- tilts

def _verdict(spark, stage=0, st_conf=0.0, phase=0, lt_conf=0.0, rr=None, st_w=None, lt_w=None, home=None):
    st = {k: float((st_w or {}).get(k, 0)) for k in range(1, 5)}
    lt = {k: float((lt_w or {}).get(k, 0)) for k in range(1, 7)}
    schema = "entity string, st_stage int, st_label string, st_confidence double, lt_phase int, lt_label string, lt_confidence double, real_rate_10y double, home double, " + ", ".join(
        [f"st_w{k} double" for k in st] + [f"lt_w{k} double" for k in lt])
    return spark.createDataFrame([("US", stage, "S", st_conf, phase, "L", lt_conf, rr, home, *st.values(), *lt.values())], schema)


def _tilts(frame, *args):
    rows = explode_tilts(asset_tilts(frame, *args), ["entity"]).orderBy("position").collect()
    assert [r.asset for r in rows] == list(ASSETS)
    return {r.asset: r.tilt for r in rows}


def test_settled_classes_read_their_rows(spark):
    for stage, row in SHORT_TERM_TILTS.items():
        assert _tilts(_verdict(spark, stage, 1.0)) == pytest.approx({a: row.get(a, 0.0) for a in ASSETS})
        assert row == QUADRANT_TILTS[STAGE_QUADRANTS[stage]]
    for phase, row in LONG_TERM_TILTS.items():
        assert _tilts(_verdict(spark, 0, 0.0, phase, 0.5)) == pytest.approx({a: 0.5 * row.get(a, 0.0) for a in ASSETS})
    assert set(_tilts(_verdict(spark, 1, 0.0, 4, 0.0)).values()) == {0.0}
    assert set(_tilts(_verdict(spark, 0, 0.0, 2, 1.0)).values()) == {0.0}


def test_transition_blends_by_weight_share(spark):
    tilts = _tilts(_verdict(spark, 0, 0.5, st_w={4: 0.6, 2: 0.5}))
    gold = 0.5 * (0.7 * 0.5 / 1.1 + 0.7 * 0.6 / 1.1)
    assert tilts["gold"] == pytest.approx(gold) and tilts["long_bonds"] == pytest.approx(0.5 * -1.2 * 0.5 / 1.1)


@pytest.mark.parametrize("rr, intensity", [(None, 0), (0.0, 0), (0.5, 0), (-0.25, 0.25), (-1.0, 1), (-3.0, 1)])
def test_real_yield_layer(spark, rr, intensity):
    tilts = _tilts(_verdict(spark, rr=rr))
    assert (tilts["gold"], tilts["long_bonds"], tilts["commodities"]) == pytest.approx((0.4 * intensity, -0.4 * intensity, 0.3 * intensity))


@pytest.mark.parametrize("home, intensity", [(2.0, 1), (1.0, 0.5), (-9.0, -1), (None, 0), (0.0, 0)])
def test_home_currency_layer(spark, home, intensity):
    frame = _verdict(spark, rr=0.0, home=home)
    tilts = _tilts(frame, "SEK", F.col("home"))
    assert (tilts["gold"], tilts["equities"], tilts["tips"]) == pytest.approx((-0.3 * intensity, -0.15 * intensity, 0.0))
    assert set(_tilts(frame, "USD", F.col("home")).values()) == {0.0}


def test_caution_regime_and_reasons(spark):
    row = asset_tilts(_verdict(spark, 2, 0.5, 5, 0.4, rr=-0.5)).first()
    assert (row.caution_level, row.real_yield_regime, row.home_currency) == ("high", "mild repression", "USD")
    gold = [t for t in row.tilts if t.asset == "gold"][0]
    assert gold.reasons.count("·") == 2 and "short term" in gold.reasons and "real yield" in gold.reasons
    tips = [t for t in row.tilts if t.asset == "tips"][0]
    assert "long term" not in tips.reasons and "caution high" in row.summary


def test_top_tilts_break_ties_by_display_order(spark):
    frame = asset_tilts(_verdict(spark, 3, 1.0))
    best = top_tilts(frame, ["entity"], 4).orderBy("rank").collect()
    assert [r.asset for r in best] == ["long_bonds", "equities", "credit", "commodities"]
    windowed = rank_long_tilts(explode_tilts(frame, ["entity"]), ["entity"], 4).orderBy("rank").collect()
    assert [r.asset for r in windowed] == [r.asset for r in best]


@pytest.mark.parametrize("tilt, arrow", [(1.6, "↑↑↑"), (1.5, "↑↑↑"), (1.0, "↑↑"), (0.4, "↑"), (0.1, "→"), (-0.1, "→"), (-0.2, "↓"), (-1.0, "↓↓"), (-1.6, "↓↓↓")])
def test_arrows(spark, tilt, arrow):
    assert spark.range(1).select(scalars.direction(F.lit(tilt)).alias("a")).first().a == arrow


@pytest.mark.parametrize("g, c, quadrant", [(2.0, 2.0, "G↑I↑"), (1.99, 2.01, "G↓I↑"), (None, None, "G↑I↑"), (3.0, 1.0, "G↑I↓"), (1.0, 1.0, "G↓I↓")])
def test_quadrants(spark, g, c, quadrant):
    frame = spark.createDataFrame([(g, c)], "g double, c double")
    assert frame.select(scalars.quadrant(F.col("g"), F.col("c")).alias("q")).first().q == quadrant


@pytest.mark.parametrize("metric, value, label", [("credit_spread_z", 2.0, "normal range"), ("credit_spread_z", 2.1, "unusually wide"), ("credit_spread_z", -1.5, "normal range"),
                                                  ("yield_curve", 0.0, "flat"), ("real_rate", -1.0, "mildly negative"), ("total_debt", 100.0, "low"), ("total_debt", None, None)])
def test_status_bands(spark, metric, value, label):
    frame = spark.createDataFrame([(value,)], "v double")
    assert frame.select(scalars.status_band(metric, F.col("v")).alias("b")).first().b == label


# ---- views

MINIMAL = {"policy_rate": 4.0, "cpi_yoy": 3.0, "unemployment_rate": 4.0, "yield_10y": 4.5, "yield_2y": 4.0, "real_gdp_yoy": 2.0,
           "total_credit_pct_gdp": 250.0, "debt_service_ratio": 14.0}


@pytest.fixture(scope="module")
def minimal(panel_of):
    return panel_of([("US", i, "2026-04-01", v) for i, v in MINIMAL.items()])


def test_world_view_of_one_country(spark, minimal):
    rows = {r.entity: r for r in world_view(minimal, entity_dim(spark), day("2026-05-01")).collect()}
    assert len(rows) == 8 and sum(not r.has_data for r in rows.values()) == 7
    assert rows["US"].total_debt_pct_gdp == 250.0 and rows["US"].real_rate_10y == 1.5 and rows["US"].lt_phase == 3
    assert (rows["SE"].lt_label, rows["SE"].caution_level, rows["SE"].st_stage, rows["SE"].cpi_yoy) == ("No data", "moderate", 0, None)
    early = {r.entity: r for r in world_view(minimal, entity_dim(spark), day("2020-01-01")).collect()}
    assert early["US"].has_data and early["US"].lt_label == "Transition (insufficient data)"


def test_home_lookup(spark, minimal, panel_of):
    both = minimal.unionByName(panel_of([("SE", "yield_10y", "2026-03-01", 5.0), ("SE", "cpi_yoy", "2026-03-01", 1.0)]))
    grid = [day("2026-05-01")]
    gold = {c: {r.entity: [t.tilt for t in r.tilts if t.asset == "gold"][0] for r in entity_views(both, grid, c).collect()} for c in ("USD", "SEK", "INR", "GBP")}
    assert gold["SEK"]["US"] == pytest.approx(gold["USD"]["US"] - 0.3)
    assert gold["SEK"]["SE"] == pytest.approx(gold["USD"]["SE"])
    assert gold["INR"] == gold["USD"] and gold["GBP"] == gold["USD"]


def test_all_home_currencies_at_once(spark, minimal, panel_of):
    """One row per entity and currency, each as the view from that currency alone."""
    both = minimal.unionByName(panel_of([("SE", "yield_10y", "2026-03-01", 5.0), ("SE", "cpi_yoy", "2026-03-01", 1.0), ("GB", "yield_10y", "2026-03-01", 2.0)]))
    grid, currencies = [day("2026-02-01"), day("2026-05-01")], ["USD", "SEK", "INR", "GBP", "BRL", "SEK"]
    found = viewer_views(both, grid, currencies, every_date=True).collect()
    at_once = {(r.entity, r.as_of, r.home_currency): (r.tilts, r.summary) for r in found}
    assert len(found) == len(at_once) == 3 * 2 * 5
    for currency in set(currencies):
        for r in entity_views(both, grid, currency, every_date=True).collect():
            assert at_once[r.entity, r.as_of, currency] == (r.tilts, r.summary)
    gold = {k: next(t.tilt for t in v[0] if t.asset == "gold") for k, v in at_once.items() if k[1] == grid[1]}
    assert gold["SE", grid[1], "SEK"] == gold["SE", grid[1], "USD"] and gold["US", grid[1], "SEK"] != gold["US", grid[1], "USD"]
    assert all(gold[e, grid[1], c] == gold[e, grid[1], "USD"] for e in ("US", "SE", "GB") for c in ("INR", "BRL"))
    plan = viewer_views(both, grid, currencies)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_entities_of_three_columns_are_entities(spark, minimal):
    """The whole replay over (a, b, c) keys is the replay over one joined key."""
    keyed = minimal.select(F.col("entity").alias("a"), F.lit(7).alias("b"), F.lit(None).cast("string").alias("c"), *minimal.columns[1:])
    cols = PanelColumns(entity=("a", "b", "c"))
    options = {"start": day("2020-01-01"), "end": day("2026-06-01"), "step": "Y", "signal_asof": "none"}
    one = replay(minimal, **options)
    three = replay(keyed.withColumn("c", F.lit("x")), **options, cols=cols)
    assert three.columns[:3] == ["a", "b", "c"]
    assert sorted(map(str, three.select(F.col("a").alias("entity"), *one.columns[1:]).collect())) == sorted(map(str, one.collect()))
    signal = replay(keyed.withColumn("c", F.lit("x")), **{**options, "signal_asof": "today"}, signal_entities=[("US", 7, "x")], cols=cols)
    assert signal.count() == one.count()


def test_blocs(spark):
    dim = entity_dim(spark)
    expanded = expand_blocs(dim)
    assert expanded.count() == 7 + len(BLOC_MEMBERS["EMU"]) == 27
    back = {r.map_iso3: r.e for r in expanded.select("map_iso3", member_to_entity(F.col("map_iso3")).alias("e")).collect()}
    assert (back["FRA"], back["HRV"], back["GBR"]) == ("EU", "EU", "UK")
    assert spark.createDataFrame([("ZZZ",), ("EMU",)], "c string").where(member_to_entity(F.col("c")).isNotNull()).count() == 0


def test_enrichment_is_case_insensitive_and_strict(spark):
    dim = entity_dim(spark)
    rows = spark.createDataFrame([("us",), ("Se",)], "code string")
    assert {r.code: (r.name, r.currency) for r in enrich(rows, dim, "code").collect()} == {"us": ("United States", "USD"), "Se": ("Sweden", "SEK")}
    assert {r.provider_code for r in translate_code(spark.createDataFrame([("eu",)], "code string"), dim, "code", "bis_code").collect()} == {"XM"}
    bad = rows.unionByName(spark.createDataFrame([("ZZ",)], "code string"))
    assert [r._code for r in unknown_codes(bad, dim, "code").collect()] == ["ZZ"]
    with pytest.raises(Exception, match="unknown entity code"):
        enrich(bad, dim, "code").collect()


def test_presence(spark, minimal):
    flags = {r.entity: r.has_data for r in flag_presence(entity_dim(spark), minimal).collect()}
    assert flags["US"] and not flags["SE"]
    listed = available_indicators(minimal, ["yield_2y", "hy_spread", "cpi_yoy"]).orderBy("position").collect()
    assert [(r.indicator, r.position) for r in listed] == [("yield_2y", 0), ("cpi_yoy", 2)]
