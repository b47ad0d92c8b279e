"""As-of lookups, lags, snapshots and the equivalences between plans."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcycle.operators.asof import asof_grid, asof_join, latest_at, with_anchor_lags
from panelcycle.operators.canonical import canonical_panel, duplicate_keys
from panelcycle.operators.snapshot import feature_snapshots, indicator_dates, with_derived_features

D = dt.date(2026, 4, 1)


def ago(n):
    return D - dt.timedelta(days=n)


@pytest.fixture(scope="module")
def lagged_panel(panel_of):
    return panel_of([
        ("US", "cpi_yoy", D, 3.5), ("US", "cpi_yoy", ago(30), 3.3), ("US", "cpi_yoy", ago(90), 3.0), ("US", "cpi_yoy", ago(120), 2.8),
        ("US", "policy_rate", D, 3.0), ("US", "policy_rate", ago(180), 4.5),
        ("US", "total_credit_pct_gdp", dt.date(2025, 7, 1), 250.0),
        ("US", "total_credit_pct_gdp", dt.date(2025, 7, 1) - dt.timedelta(days=1825), 290.0),
    ])


def test_snapshot_with_lags(lagged_panel):
    row = with_derived_features(feature_snapshots(lagged_panel, [dt.date(2026, 5, 1)])).first()
    assert (row.cpi_yoy, row.cpi_yoy_3m_ago, row.policy_rate_6m_ago) == (3.5, 3.0, 4.5)
    assert row.unemployment_rate is None and row.unemployment_change_3m is None
    assert row.total_credit_5y_change_pp == -40.0
    assert row.st_data_date == D and row.lt_data_date == D and row.cpi_yoy_date == D


def test_lag_hangs_on_the_row_found_not_on_the_asked_date(panel_of):
    panel = panel_of([("US", "cpi_yoy", "2020-01-01", 1.0), ("US", "cpi_yoy", "2020-06-01", 2.0), ("US", "cpi_yoy", "2019-11-01", 0.5)])
    row = feature_snapshots(panel, [dt.date(2020, 5, 31)]).first()
    assert (row.cpi_yoy, row.cpi_yoy_3m_ago) == (1.0, None)
    row = feature_snapshots(panel, [dt.date(2025, 1, 1)]).first()
    assert (row.cpi_yoy, row.cpi_yoy_3m_ago) == (2.0, 1.0)


def test_dates_map_holds_found_indicators_only(lagged_panel):
    snapshot = feature_snapshots(lagged_panel, [D])
    assert snapshot.select(indicator_dates().alias("m")).first().m == {
        "cpi_yoy": D, "policy_rate": D, "total_credit_pct_gdp": dt.date(2025, 7, 1)
    }


def test_listed_entities_without_data_get_rows(spark, lagged_panel):
    entities = spark.createDataFrame([("US",), ("ZZ",)], "entity string")
    rows = feature_snapshots(lagged_panel, [ago(400), D], entities).collect()
    assert len(rows) == 4
    assert all(r.cpi_yoy is None for r in rows if r.entity == "ZZ" or r.as_of == ago(400))


def test_same_day_sources_follow_the_priority(panel_of):
    panel = panel_of([("US", "x", D, 1.0, "BIS"), ("US", "x", D, 2.0, "FRED"), ("US", "x", ago(1), 9.0, "BIS"), ("US", "x", D, 3.0, "ZED")])
    for priority, value in ((("FRED", "BIS"), 2.0), (("BIS",), 1.0)):
        assert latest_at(panel, D, priority).first().value == value
        assert canonical_panel(panel, priority).where(F.col("date") == F.lit(D)).first().value == value
        assert asof_grid(panel, [D], priority=priority).first().value == value
    picks = {latest_at(panel, D).first().value, asof_grid(panel, [D]).first().value,
             canonical_panel(panel).where(F.col("date") == F.lit(D)).first().value}
    assert len(picks) == 1  # unlisted sources: arbitrary, but everywhere the same
    assert duplicate_keys(panel).count() == 0
    assert duplicate_keys(panel.unionByName(panel)).count() == 4


@pytest.fixture(scope="module")
def random_panel(panel_of):
    rng = random.Random(7)
    rows = set()
    for entity in "ABC":
        for indicator in ("x", "y"):
            for _ in range(rng.randrange(5, 60)):
                rows.add((entity, indicator, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(1500)), rng.choice(("S1", "S2"))))
    return panel_of([(e, i, d, rng.random(), s) for e, i, d, s in sorted(rows)])


GRID = [dt.date(1999, 12, 1)] + [dt.date(2000 + m // 12, m % 12 + 1, 1) for m in range(0, 60, 5)]


def brute(panel, targets, priority):
    """(entity, indicator, target) -> newest (value, date), by looping over all rows."""
    rank = {s: i for i, s in enumerate(priority)}
    rows = panel.collect()
    out = {}
    for entity, indicator, target in targets:
        seen = [r for r in rows if r.entity == entity and r.indicator == indicator and r.date <= target]
        if seen:
            best = max(seen, key=lambda r: (r.date, -rank[r.source]))
            out[entity, indicator, target] = (best.value, best.date)
    return out


def test_slots_window_and_brute_force_agree(spark, random_panel):
    priority = ("S2", "S1")
    targets = [(e, i, g) for e in "ABC" for i in ("x", "y") for g in GRID]
    expected = brute(random_panel, targets, priority)
    slots = {(r.entity, r.indicator, r.as_of): (r.value, r.observed_on) for r in asof_grid(random_panel, GRID, priority=priority).collect()}
    assert slots == expected
    probes = spark.createDataFrame(targets + targets[:5], "entity string, indicator string, as_of date")
    joined = asof_join(probes, random_panel, priority=priority).collect()
    assert len(joined) == len(targets) + 5
    assert {(r.entity, r.indicator, r.as_of): (r.value, r.observed_on) for r in joined if r.observed_on} == expected
    one = {(r.entity, r.indicator): (r.value, r.observed_on) for r in latest_at(random_panel, GRID[4], priority).collect()}
    assert one == {(e, i): v for (e, i, g), v in expected.items() if g == GRID[4]}


def test_range_lag_equals_a_range_join(random_panel):
    priority = ("S1", "S2")
    daily = canonical_panel(random_panel, priority)
    lagged = with_anchor_lags(daily, [90]).collect()
    expected = brute(random_panel, [(r.entity, r.indicator, r.date - dt.timedelta(days=90)) for r in lagged], priority)
    for r in lagged:
        found = expected.get((r.entity, r.indicator, r.date - dt.timedelta(days=90)))
        assert r.lag_90d == (found[0] if found else None)


def test_row_order_and_partitions_do_not_matter(random_panel):
    a = asof_grid(random_panel, GRID, [90], ("S1", "S2"))
    b = asof_grid(random_panel.orderBy(F.desc("value")).repartition(7), GRID, [90], ("S1", "S2"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_extreme_dates_keep_their_order(panel_of):
    panel = panel_of([("A", "x", "0001-01-01", 1.0), ("A", "x", "9999-12-31", 2.0), ("A", "x", "1970-01-01", 3.0)])
    assert latest_at(panel, dt.date(9999, 12, 31)).first().value == 2.0
    assert latest_at(panel, dt.date(1969, 12, 31)).first().value == 1.0


def test_grid_must_ascend(random_panel):
    with pytest.raises(ValueError):
        asof_grid(random_panel, [D, ago(1)])


def test_lags_and_slots_share_one_sort(spark):
    """Snapshots with lags hold the sorted rows once, without an aggregate by slot beside them; answers as by hand."""
    rng = random.Random(5)
    days = {(e, i): rng.sample(range(900), 60) for e in "abc" for i in ("cpi_yoy", "policy_rate")}
    rows = [(e, i, ago(900 - d), None if rng.random() < 0.1 else float(d)) for (e, i), found in days.items() for d in found]
    daily = spark.createDataFrame(rows, "entity string, indicator string, date date, value double")
    grid = [ago(n) for n in (950, 700, 650, 649, 300, 20)]
    frame = asof_grid(daily, grid, [90], one_row_per_day=True)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Aggregate" not in plan

    def at(series, day):
        return max((r for r in rows if r[:2] == series and r[2] <= day), key=lambda r: r[2], default=None)

    expected = set()
    for series in days:
        for day in grid:
            if (row := at(series, day)) is not None:
                lag = at(series, row[2] - dt.timedelta(days=90))
                expected.add((*series, day, row[3], row[2], lag and lag[3]))
    got = frame.select("entity", "indicator", "as_of", "value", "observed_on", "lag_90d").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
