"""Rule outcomes on hand-made feature rows."""

from __future__ import annotations

import pytest

from panelcycle.operators.rules import SHORT_TERM_RULES, Rule, case, text
from panelcycle.operators.thresholds import with_thresholds
from panelcycle.operators.snapshot import with_derived_features
from panelcycle.operators.votes import cast_votes, decide
from panelcycle.catalog.indicators import ALL_INDICATORS, LAGGED_FEATURES
from panelcycle.plans.classify import classify_long_term, classify_short_term

NAMES = [*ALL_INDICATORS, *LAGGED_FEATURES]
# The scenarios' numbers, here and in the case lists.
SHORT = dict(real_gdp_yoy=2.0, cpi_yoy=2.5, cpi_yoy_3m_ago=2.5, unemployment_rate=4.0, unemployment_3m_ago=4.0,
             policy_rate=3.0, policy_rate_6m_ago=3.0, yield_10y=4.0, yield_2y=3.5)
LONG = dict(total_credit_pct_gdp=200.0, total_credit_5y_ago=180.0, gov_debt_pct_gdp=80.0, private_nonfin_pct_gdp=120.0,
            hh_debt_pct_gdp=60.0, corp_debt_pct_gdp=60.0, debt_service_ratio=14.0, debt_service_5y_ago=13.0, yield_10y=4.0, cpi_yoy=3.0)


@pytest.fixture(scope="module")
def features(spark):
    def build(rows, thresholds=None):
        schema = "entity string, hy_spread double, hy_spread_z double, " + ", ".join(f"{n} double" for n in NAMES) + ", " + ", ".join(
            f"{n}_date date" for n in ALL_INDICATORS
        )
        data = [(str(i), None, r.get("hy_spread_z"), *[r.get(n) for n in NAMES], *[None] * len(ALL_INDICATORS)) for i, r in enumerate(rows)]
        return with_thresholds(with_derived_features(spark.createDataFrame(data, schema)), thresholds)

    return build


SHORT_CASES = [
    (dict(real_gdp_yoy=-0.5), 3),
    (dict(unemployment_rate=4.8), 3),
    (dict(cpi_yoy=4.5, policy_rate=4.5, policy_rate_6m_ago=3.5), 2),
    (dict(cpi_yoy=5.5), 2),
    (dict(policy_rate=2.0, policy_rate_6m_ago=3.5, cpi_yoy=2.0, cpi_yoy_3m_ago=3.0), 4),
    (dict(real_gdp_yoy=2.5, cpi_yoy=2.2, cpi_yoy_3m_ago=2.2, unemployment_rate=3.8), 1),
]


def test_short_term_stages(features):
    rows = classify_short_term(features([{**SHORT, **o} for o, _ in SHORT_CASES])).orderBy("entity").collect()
    assert [r.st_stage for r in rows] == [s for _, s in SHORT_CASES]
    assert all(v.reason for r in rows for v in r.st_votes)


def test_short_term_without_data(features):
    row = classify_short_term(features([{}])).first()
    assert (row.st_stage, row.st_label, row.st_confidence, row.st_votes) == (0, "Transition (insufficient data)", 0.0, [])


def test_confidence_saturates_and_votes_keep_rule_order(features):
    row = classify_short_term(features([{**SHORT, "real_gdp_yoy": -0.5, "yield_2y": 4.5}])).first()
    assert [(v.cls, v.weight) for v in row.st_votes] == [(3, 1.0), (3, 0.4)]
    assert row.st_confidence == pytest.approx(1.4 / 2.4)


def test_missing_unemployment_still_allows_a_lenient_expansion(features):
    row = classify_short_term(features([{**SHORT, "unemployment_rate": None}])).first()
    assert [(v.cls, v.weight) for v in row.st_votes] == [(1, 0.6)]
    rising = classify_short_term(features([{**SHORT, "unemployment_rate": 4.35}])).first()
    assert 1 not in [v.cls for v in rising.st_votes]


@pytest.mark.parametrize(
    "override, votes",
    [
        (dict(cpi_yoy=3.5, policy_rate=3.6), [(2, 0.9), (2, 0.4)]),
        (dict(cpi_yoy=3.5, cpi_yoy_3m_ago=3.2), [(2, 0.5)]),
        (dict(policy_rate=2.0, cpi_yoy=4.5, cpi_yoy_3m_ago=4.5), [(2, 1.0), (4, 0.6)]),
        (dict(policy_rate=2.7, cpi_yoy=3.0, cpi_yoy_3m_ago=3.0), [(4, 0.6)]),
        (dict(policy_rate=2.7, cpi_yoy=None), [(4, 0.4)]),
        (dict(policy_rate=2.5, cpi_yoy=3.0, cpi_yoy_3m_ago=3.0), [(4, 0.6)]),
        (dict(yield_2y=2.5, real_gdp_yoy=1.0), [(1, 0.3)]),
        (dict(unemployment_rate=4.375, real_gdp_yoy=1.0), [(3, 0.5)]),
    ],
)
def test_short_term_branches(features, override, votes):
    row = classify_short_term(features([{**SHORT, **override}])).first()
    assert [(v.cls, v.weight) for v in row.st_votes] == votes


LONG_CASES = [
    (dict(total_credit_pct_gdp=80.0, total_credit_5y_ago=70.0), 1),
    (dict(total_credit_pct_gdp=357.0, total_credit_5y_ago=370.0, debt_service_ratio=15.3), 4),
    (dict(total_credit_pct_gdp=219.0, total_credit_5y_ago=305.0, cpi_yoy=3.4, yield_10y=4.7), 6),
    (dict(total_credit_pct_gdp=200.0, total_credit_5y_ago=190.0, yield_10y=1.0, cpi_yoy=4.0), 6),
    (dict(total_credit_pct_gdp=200.0, total_credit_5y_ago=215.0, debt_service_ratio=20.0, cpi_yoy=2.0), 5),
    (dict(total_credit_pct_gdp=150.0, total_credit_5y_ago=140.0), 2),
    (dict(total_credit_pct_gdp=240.0, total_credit_5y_ago=220.0), 3),
]


def test_long_term_phases(features):
    rows = classify_long_term(features([{**LONG, **o} for o, _ in LONG_CASES])).orderBy("entity").collect()
    assert [r.lt_phase for r in rows] == [s for _, s in LONG_CASES]


@pytest.mark.parametrize("z, votes", [(-2.0, [(2, 1.0), (3, 0.5)]), (0.2, [(2, 1.0)]), (None, [(2, 1.0)]), (2.5, [(2, 1.0), (4, 0.4)]),
                                      (-1.5, [(2, 1.0)]), (2.0, [(2, 1.0)])])
def test_credit_spread_votes(features, z, votes):
    row = classify_long_term(features([{**LONG, "total_credit_pct_gdp": 190.0, "hy_spread_z": z}])).first()
    assert [(v.cls, v.weight) for v in row.lt_votes] == votes


def test_margin_of_point_three_is_decided_in_binary_doubles(features):
    """0.7 - 0.4 lies below 0.3, 1.0 - 0.7 does not."""
    torn = classify_long_term(features([dict(total_credit_pct_gdp=190.0, debt_service_ratio=23.0)])).first()
    assert [(v.cls, v.weight) for v in torn.lt_votes] == [(2, 0.4), (5, 0.7)]
    assert torn.lt_phase == 0 and torn.lt_label == "Transition (Deleveraging ↔ Debt outpaces income)"
    clear = classify_long_term(features([dict(total_credit_pct_gdp=190.0, total_credit_5y_ago=100.0, debt_service_ratio=23.0)])).first()
    assert [(v.cls, v.weight) for v in clear.lt_votes] == [(2, 1.0), (5, 0.7)] and clear.lt_phase == 2


def test_ties_name_the_lower_class_first(features):
    row = classify_short_term(features([dict(real_gdp_yoy=-1.0, cpi_yoy=4.5)])).first()
    assert row.st_stage == 0 and row.st_label == "Transition (Inflationary peak ↔ Recession)"


def test_explicit_thresholds_override(features):
    strict = classify_short_term(features([SHORT], {"cpi_elevated": 2.0, "cpi_peak": 2.4})).first()
    assert (2, 1.0) in [(v.cls, v.weight) for v in strict.st_votes]


def test_filtering_on_the_verdict(features):
    found = classify_short_term(features([{**SHORT, **o} for o, _ in SHORT_CASES])).where("st_stage = 3")
    assert found.count() == 2


def test_users_may_bring_their_own_rules(spark):
    rules = (Rule("big", 1, case(("x > 1D", 1.0)), text("x is %.1f", "x")), Rule("neg", 2, case(("x < 0D", 0.5)), "'negative'"))
    frame = spark.createDataFrame([(2.0,), (-1.0,), (0.5,)], "x double")
    rows = decide(cast_votes(frame, rules, "r"), (1, 2), {0: "None", 1: "Big", 2: "Negative"}, "r", "cls", "label", "conf").orderBy("x").collect()
    assert [(r.cls, r.label) for r in rows] == [(2, "Negative"), (0, "None (insufficient data)"), (1, "Big")]
    single = decide(cast_votes(frame, rules[:1], "r"), (1,), {0: "None", 1: "Big"}, "r", "cls", "label", "conf")
    assert sorted(r.cls for r in single.collect()) == [0, 0, 1]


def test_rule_names_are_unique():
    assert len({r.name for r in SHORT_TERM_RULES}) == len(SHORT_TERM_RULES)
