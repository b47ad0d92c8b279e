"""Quantiles, thresholds and z-scores."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from panelcycle.catalog.thresholds import CALIBRATION_QUANTILES, DEFAULT_THRESHOLDS
from panelcycle.operators import rank_trees
from panelcycle.operators.quantiles import expanding_quantiles, series_quantiles
from panelcycle.operators.signals import credit_signal, trailing_zscore, trailing_zscore_grid
from panelcycle.operators.thresholds import calibrated_thresholds, threshold_deltas, with_thresholds
from tests.conftest import months

START = "2010-01-01"


def series(entity, indicator, values):
    return [(entity, indicator, d, v) for d, v in zip(months(START, len(values)), values)]


@pytest.mark.parametrize("limit", [None, 10**9, 1])
def test_known_quantiles_on_both_ways(panel_of, limit):
    panel = panel_of(series("A", "x", range(1, 41)) + series("B", "x", range(39)))
    rows = {r.entity: r for r in series_quantiles(panel, CALIBRATION_QUANTILES, 40, large_series_rows=limit).collect()}
    assert (rows["A"].q50, rows["A"].q75, rows["A"].q90, rows["A"].q95) == pytest.approx((20.5, 30.25, 36.1, 38.05))
    assert rows["B"].n_obs == 39 and rows["B"].q50 is None


@pytest.mark.parametrize("seed", range(3))
def test_large_series_way_is_exact(panel_of, seed):
    """Heavy ties, negatives, extremes and single values against a reference quantile."""
    rng = random.Random(seed)
    groups = {
        "ties": [rng.choice((1.0, 2.0, 2.0, 5.0)) for _ in range(400)],
        "wide": [rng.gauss(0, 1) * 10 ** rng.randrange(-5, 12) for _ in range(700)],
        "one": [3.25],
        "flat": [7.0] * 50,
        "hot": [rng.random() for _ in range(1500)],
        "ends": [-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324] * 20,
    }
    rows = [(g, "x", dt.date(2000, 1, 1) + dt.timedelta(days=i), v) for g, vs in groups.items() for i, v in enumerate(vs)]
    probs = (0.0, 0.1, 0.5, 0.75, 0.95, 1.0)
    found = {r.entity: r for r in series_quantiles(panel_of(rows), probs, large_series_rows=40).collect()}
    assert set(found) == set(groups)
    for name, values in groups.items():
        ours = [found[name][f"q{round(p * 100):02d}"] for p in probs]
        assert ours == pytest.approx(list(np.quantile(values, probs)), rel=1e-12, abs=1e-12), name


def test_large_series_with_infinite_values(panel_of):
    values = [float("-inf"), -1.0, 2.0, float("inf"), float("inf")]
    rows = [("A", "x", d, v) for d, v in zip(months(START, 5), values)]
    found = series_quantiles(panel_of(rows), (0.0, 0.25, 0.5, 1.0), large_series_rows=1).first()
    assert [found.q00, found.q25, found.q50, found.q100] == [float("-inf"), -1.0, 2.0, float("inf")]


def test_thresholds_fall_back_field_by_field(spark, panel_of):
    panel = panel_of(series("DSR", "debt_service_ratio", range(40)) + series("CPI", "cpi_yoy", [0.5] * 40) + series("HOT", "cpi_yoy", range(40))
                     + series("FEW", "cpi_yoy", [9.0] * 39))
    own = calibrated_thresholds(panel)
    everyone = spark.createDataFrame([(e,) for e in ("DSR", "CPI", "HOT", "FEW", "NONE")], "entity string")
    rows = {r.entity: r for r in with_thresholds(everyone, own).collect()}
    assert (rows["DSR"].dsr_stretched, rows["DSR"].dsr_distress, rows["DSR"].dsr_extreme) == pytest.approx((29.25, 35.1, 37.05))
    assert (rows["DSR"].debt_extreme, rows["DSR"].cpi_peak) == (280.0, 4.0)
    assert (rows["CPI"].cpi_elevated, rows["CPI"].cpi_peak) == (2.5, 3.5)
    assert (rows["HOT"].cpi_elevated, rows["HOT"].cpi_peak) == pytest.approx((29.25, 35.1))
    for entity in ("FEW", "NONE"):
        assert {n: rows[entity][n] for n in DEFAULT_THRESHOLDS} == DEFAULT_THRESHOLDS
    deltas = {(r.entity, r.field): r.delta for r in threshold_deltas(own).collect()}
    assert deltas["CPI", "cpi_elevated"] == -0.5 and deltas["CPI", "debt_extreme"] == 0.0


def test_tight_spread_scores_low(panel_of):
    panel = panel_of(series("US", "hy_spread", [5.0] * 39 + [2.0]) + series("SE", "hy_spread", [5.0] * 39 + [2.0]) + series("FLAT", "hy_spread", [0.1] * 45)
                     + series("FEW", "hy_spread", [1.0] * 39))
    today = dt.date(2014, 1, 1)
    rows = {r.entity: r for r in trailing_zscore(panel.where("indicator = 'hy_spread'"), today).collect()}
    values = np.array([5.0] * 39 + [2.0])
    assert rows["US"].z == pytest.approx((2.0 - values.mean()) / values.std()) and rows["US"].latest == 2.0
    assert (rows["FLAT"].latest, rows["FLAT"].z) == (0.1, 0.0)
    assert rows["FEW"].latest is None and rows["FEW"].z is None
    assert [r.entity for r in credit_signal(panel, today).collect()] == ["US"]


def test_window_start_and_point_in_time(panel_of):
    panel = panel_of(series("US", "hy_spread", [float(i % 7) for i in range(120)]))
    today = dt.date(2019, 12, 1)
    short = trailing_zscore(panel, today, window_days=45 * 30).first()
    assert short.n_obs == 45
    grid = [dt.date(2013, 6, 15), dt.date(2016, 2, 1), today]
    on_grid = {r.as_of: r for r in trailing_zscore_grid(panel, grid).collect()}
    for day in grid:
        seen = panel.where(f"date <= DATE '{day}'")
        alone = trailing_zscore(seen, day).first()
        assert on_grid[day].n_obs == alone.n_obs and on_grid[day].z == pytest.approx(alone.z)


@pytest.mark.parametrize("limit", [None, 10**9, 60])
def test_expanding_quantiles_see_no_later_row(panel_of, limit):
    """Two sources a month; on each date the answer is that of the rows up to it."""
    rng = random.Random(5)
    days = months("2000-01-01", 60)
    rows = [("A", "x", d, rng.random(), s) for d in days for s in ("S", "T")] + [("B", "x", d, float(i)) for i, d in enumerate(days[:20])]
    grid = [dt.date(1999, 1, 1), dt.date(2000, 6, 15), dt.date(2000, 6, 20), dt.date(2002, 1, 1), dt.date(2010, 1, 1)]
    found = {(r.entity, r.as_of): r for r in expanding_quantiles(panel_of(rows), grid, (0.5, 0.9), 12, limit).collect()}
    assert len(found) == 8
    for (entity, as_of), row in found.items():
        seen = [v for e, _, d, v, *_ in rows if e == entity and d <= as_of]
        assert row.n_obs == len(seen)
        expected = list(np.quantile(seen, (0.5, 0.9))) if len(seen) >= 12 else [None, None]
        assert [row.q50, row.q90] == (pytest.approx(expected) if len(seen) >= 12 else expected)


# ---- running quantiles and periods

@pytest.mark.parametrize("chunk", [1, 40, 10**6])
def test_rank_trees_against_numpy(spark, monkeypatch, chunk):
    """Values come and go; one series holds a third of the rows; keys may be null; chunks hold whole series."""
    monkeypatch.setattr(rank_trees, "CHUNK_ROWS", chunk)
    rng = random.Random(chunk)
    held: dict = {}
    events, expected = [], {}
    keys = [("HOT", "x"), (None, "x"), ("A", None), ("A", "x"), ("B", "y"), ("C", "y")]
    for slot in range(0, 60, 2):
        touched = set()
        for _ in range(rng.randrange(9)):
            key = keys[0] if rng.random() < 0.33 else rng.choice(keys)
            values = held.setdefault(key, [])
            if values and rng.random() < 0.4:
                gone = values.pop(rng.randrange(len(values)))
                events.append((*key, slot, gone, -1))
            else:
                value = rng.choice((1.0, -0.0, 0.0, 2.5, rng.gauss(0, 1e6), 5e-324))
                values.append(value)
                events.append((*key, slot, value, 1))
            touched.add(key)
        expected.update({(*key, slot): list(held[key]) for key in touched})
    probs = [0.0, 0.3, 0.5, 0.95, 1.0]
    frame = spark.createDataFrame(events, "entity string, indicator string, slot int, _v double, _sign int").repartition(3)
    found = {(r.entity, r.indicator, r.slot): r for r in rank_trees.running_quantiles(frame, ["entity", "indicator"], probs).collect()}
    assert set(found) == set(expected)
    for key, values in expected.items():
        assert found[key].n_obs == len(values)
        if values:
            assert list(found[key]["_q"]) == pytest.approx(list(np.quantile(values, probs)), abs=1e-9)
        later = [s for e, i, s in expected if (e, i) == key[:2] and s > key[2]]
        assert found[key]["_next"] == (min(later) if later else None)


def test_rank_trees_of_nothing(spark):
    frame = spark.createDataFrame([], "entity string, indicator string, slot int, _v double, _sign int")
    assert rank_trees.running_quantiles(frame, ["entity", "indicator"], [0.5]).count() == 0


def _scores(values, grid, window, minimum=3):
    out = {}
    for g in grid:
        inside = [(d, v) for d, v in values if g - dt.timedelta(days=window) <= d <= g]
        if len(inside) >= minimum:
            found = np.array([v for _, v in inside])
            spread = float(np.sqrt(np.mean((found - found.mean()) ** 2)))
            out[g] = (len(inside), 0.0 if found.min() == found.max() else (max(inside)[1] - found.mean()) / spread)
    return out


@pytest.mark.parametrize("window", [1, 10, 90, 365, 20_000])
@pytest.mark.parametrize("level", [0.0, 1e9])
def test_scores_over_uneven_grids(panel_of, window, level):
    """Windows shorter and longer than the grid's steps, and a level at which naive squares cancel."""
    rng = random.Random(window)
    values = [(dt.date(2000, 1, 1) + dt.timedelta(days=k), level + rng.gauss(0, 1)) for k in sorted(rng.sample(range(1500), 500))]
    grid = sorted({dt.date(1999, 12, 1) + dt.timedelta(days=rng.choice((rng.randrange(1700), 7 * rng.randrange(60)))) for _ in range(90)})
    rows = trailing_zscore_grid(panel_of([("A", "x", d, v) for d, v in values]), grid, window, 3).collect()
    expected = _scores(values, grid, window)
    assert {r.as_of for r in rows if r.z is not None} == set(expected)
    for r in rows:
        if r.z is not None:
            assert r.n_obs == expected[r.as_of][0] and r.z == pytest.approx(expected[r.as_of][1], rel=1e-6, abs=1e-6)


def test_a_value_that_left_the_window_leaves_no_trace(panel_of):
    """An outlier of 1e15 passes through; the scores after it are those of a series that never had it."""
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(400)]
    values = [(d, 1e15 if k == 20 else float(k % 7)) for k, d in enumerate(days)]
    grid = [days[k] for k in range(10, 400, 9)]
    rows = {r.as_of: r.z for r in trailing_zscore_grid(panel_of([("A", "x", d, v) for d, v in values]), grid, 40, 3).collect()}
    clean = _scores([(d, v) for d, v in values if v < 1e9], grid, 40)
    without = [g for g in grid if not g - dt.timedelta(days=40) <= days[20] <= g]
    assert min(without) < days[20] < days[20 + 41] <= min(g for g in without if g > days[20])
    for g in without:
        assert rows[g] == pytest.approx(clean[g][1], rel=1e-9, abs=1e-9)


def test_rows_of_a_score_are_two_a_date(panel_of):
    """What is repeated over the grid: two halves a date, not the blocks that a window holds."""
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=k) for k in range(800)]
    grid = days[::4]
    frame = trailing_zscore_grid(panel_of([("A", "x", d, 1.0 * k) for k, d in enumerate(days)]), grid, 700, 3)
    assert frame.count() == len(grid)
    text = frame._jdf.queryExecution().optimizedPlan().toString()
    repeated = [line for line in text.splitlines() if "Generate explode(sequence(" in line and "low#" not in line]
    assert len(repeated) == 1 and "_from#" in repeated[0]
