"""As-of by date and load time against loops over the whole log, and what follows from it."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcycle.operators.quantiles import expanding_quantiles, vintage_quantiles
from panelcycle.operators.asof import asof_grid
from panelcycle.operators.signals import aligned_ranges, trailing_zscore_grid
from panelcycle.operators.snapshot import feature_snapshots
from panelcycle.operators.upsert import merge_observations
from panelcycle.operators.vintages import asof_vintages, revision_spans
from panelcycle.plans.replay import replay
from panelcycle.schema import OBSERVATION_SCHEMA
from tests.conftest import day

GRID = [dt.date(2000, 1, 1) + dt.timedelta(days=61 * k) for k in range(20)]
FOREVER = [dt.datetime(9999, 1, 1)] * len(GRID)
PRIORITY = ("S2", "S1")
SCHEMA = "entity string, indicator string, date date, value double, source string, series_id string, fetched_at timestamp_ntz, arrival bigint"


def _rows(seed, n=700, indicators=("x", "y")):
    rng = random.Random(seed)
    out = []
    for arrival in range(n):
        date = dt.date(1999, 10, 1) + dt.timedelta(days=rng.randrange(0, 1300, 7))
        loaded = None if rng.random() < 0.03 else dt.datetime(1999, 10, 1) + dt.timedelta(days=rng.randrange(0, 1700), hours=rng.choice((0, 0, 13)))
        out.append((rng.choice("AB"), rng.choice(indicators), date, round(rng.uniform(-5, 5), 3), rng.choice(("S1", "S2")), "s", loaded, arrival))
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows(4)


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def _known(rows, g, v):
    """(entity, indicator) -> date -> {source: value} of what was dated by g and loaded by v."""
    held = {}
    early = dt.datetime.min
    for e, i, d, value, s, _, loaded, arrival in sorted(rows, key=lambda r: (r[6] or early, r[7])):
        if d <= g and (loaded or early) <= v:
            held.setdefault((e, i), {}).setdefault(d, {})[s] = value
    return held


def _pick(day_values):
    return next(day_values[s] for s in PRIORITY if s in day_values)


def _midnight(g):
    return dt.datetime(g.year, g.month, g.day)


@pytest.mark.parametrize("known_by", [GRID, FOREVER, [_midnight(g) + dt.timedelta(days=100) for g in GRID], [dt.datetime(2001, 1, 1)] * len(GRID)])
def test_two_bounds_against_a_loop(rows, log, known_by):
    found = {(r.entity, r.indicator, r.as_of): r for r in asof_vintages(log, GRID, known_by, [90, 400], PRIORITY).collect()}
    expected = 0
    for g, v in zip(GRID, known_by, strict=True):
        v = v if isinstance(v, dt.datetime) else _midnight(v)
        for (e, i), days in _known(rows, g, v).items():
            newest = max(days)
            r = found[e, i, g]
            assert (r.observed_on, r.value) == (newest, _pick(days[newest]))
            for n in (90, 400):
                older = [d for d in days if d <= newest - dt.timedelta(days=n)]
                assert r[f"lag_{n}d"] == (_pick(days[max(older)]) if older else None)
            expected += 1
    assert len(found) == expected


def _final(spark, rows):
    """The table that upserts leave: the last value of each key."""
    empty = spark.createDataFrame([], OBSERVATION_SCHEMA)
    early = dt.datetime(1900, 1, 1)
    ordered = sorted(rows, key=lambda r: (r[6] or early, r[7]))
    batch = spark.createDataFrame([(*r[:7], n) for n, r in enumerate(ordered)], SCHEMA)
    return merge_observations(empty, batch, "arrival").select(*OBSERVATION_SCHEMA.names)


def test_without_a_bound_on_load_time_it_is_the_as_of_of_the_table(spark, rows, log):
    plain = asof_grid(_final(spark, rows), GRID, [90], PRIORITY).select("entity", "indicator", "as_of", "value", "observed_on", "lag_90d")
    known = asof_vintages(log, GRID, FOREVER, [90], PRIORITY).select(*plain.columns)
    assert sorted(map(str, known.collect())) == sorted(map(str, plain.collect()))


def test_replay_of_the_newest_vintage_is_todays_replay(spark):
    names = ("cpi_yoy", "policy_rate", "total_credit_pct_gdp", "debt_service_ratio", "yield_10y", "real_gdp_yoy")
    rows = _rows(8, 1500, names)
    log = spark.createDataFrame(rows, SCHEMA)
    options = {"start": GRID[0], "end": GRID[-1], "calibration": "expanding", "signal_asof": "none", "priority": PRIORITY}
    dates = len(replay(log.limit(0), GRID[0], GRID[-1], signal_asof="none").columns)
    assert dates == 8
    grid_size = replay(_final(spark, rows), **options).select("date").distinct().count()
    latest = replay(log, **options, known_by=[dt.datetime(9999, 1, 1)] * grid_size)
    assert sorted(map(str, latest.collect())) == sorted(map(str, replay(_final(spark, rows), **options).collect()))
    honest = replay(log, **options, known_by="as_of")
    assert sorted(map(str, honest.collect())) != sorted(map(str, latest.collect())) and honest.count() <= latest.count()


def test_a_later_revision_is_not_seen_before_it_is_loaded(spark):
    rows = [("A", "cpi_yoy", day("2000-01-01"), 2.0, "S", "s", dt.datetime(2000, 2, 1), 0), ("A", "cpi_yoy", day("2000-01-01"), 9.0, "S", "s", dt.datetime(2001, 2, 1), 1),
            ("A", "cpi_yoy", day("2000-06-01"), 3.0, "S", "s", dt.datetime(2000, 7, 1, 12), 2)]
    log = spark.createDataFrame(rows, SCHEMA)
    grid = [day(d) for d in ("2000-01-15", "2000-02-01", "2000-07-01", "2000-07-02", "2001-02-01")]
    entities = spark.createDataFrame([("A",), ("Z",)], "entity string")
    found = feature_snapshots(log, grid, entities, ("cpi_yoy",), known_by=grid).orderBy("entity", "as_of").collect()
    assert [(r.entity, r.cpi_yoy, r.cpi_yoy_3m_ago, r.cpi_yoy_date) for r in found] == [
        ("A", None, None, None), ("A", 2.0, None, day("2000-01-01")), ("A", 2.0, None, day("2000-01-01")),
        ("A", 3.0, 2.0, day("2000-06-01")), ("A", 3.0, 9.0, day("2000-06-01")), *[("Z", None, None, None)] * 5,
    ]


def test_spans_of_revisions(rows, log):
    spans = revision_spans(log, GRID, GRID).collect()
    for at, g in enumerate(GRID):
        held = {(r.entity, r.indicator, r.date, r.source): r.value for r in spans if r.slot <= at and (r._until is None or at < r._until)}
        known = {(e, i, d, s): v for (e, i), days in _known(rows, g, _midnight(g)).items() for d, by in days.items() for s, v in by.items()}
        assert held == known


def test_quantiles_and_scores_of_what_was_known(rows, log):
    probs = [0.1, 0.5, 0.75, 0.99]
    found = {(r.entity, r.indicator, r.as_of): r for r in vintage_quantiles(log, GRID, GRID, probs, 3).collect()}
    scored = {(r.entity, r.indicator, r.as_of): r for r in trailing_zscore_grid(log, GRID, 300, 3, PRIORITY, GRID).collect()}
    for g in GRID:
        for key, days in _known(rows, g, _midnight(g)).items():
            values = [v for by in days.values() for v in by.values()]
            r = found[(*key, g)]
            assert r.n_obs == len(values)
            told = [r[f"q{round(p * 100):02d}"] for p in probs]
            assert told == [None] * 4 if len(values) < 3 else np.allclose(told, np.quantile(values, probs))
            inside = {d: by for d, by in days.items() if d >= g - dt.timedelta(days=300)}
            values = [v for by in inside.values() for v in by.values()]
            if values:
                r = scored[(*key, g)]
                assert r.n_obs == len(values)
                if len(values) >= 3 and min(values) < max(values):
                    assert r.z == pytest.approx((_pick(inside[max(inside)]) - np.mean(values)) / np.std(values))


@pytest.mark.parametrize("slots", [1, 2, 7, 16, 33])
def test_aligned_ranges_cover_an_interval_once(spark, slots):
    cut = spark.range(slots).crossJoin(spark.range(1, slots + 1).withColumnRenamed("id", "after")).where("id < after")
    rows = cut.select("id", "after", aligned_ranges(F.col("id").cast("int"), F.col("after").cast("int"), slots).alias("ranges")).collect()
    assert len(rows) == slots * (slots + 1) // 2
    for r in rows:
        covered = [k for level, place in r.ranges for k in range(place << level, (place + 1) << level)]
        assert sorted(covered) == list(range(r.id, r.after))
        assert len(r.ranges) <= max(1, 2 * (slots.bit_length() - 1))


@pytest.mark.parametrize("level", [0.0, 1e9])
def test_scores_of_intervals_of_every_length(spark, level):
    """Each value is replaced at a random later time, so that nearly no two are held over the same dates."""
    rng = random.Random(8)
    grid = [dt.date(2000, 1, 1) + dt.timedelta(days=3 * k) for k in range(150)]
    rows = []
    for k in range(400):
        date = dt.date(2000, 1, 1) + dt.timedelta(days=k)
        for loaded in sorted(rng.sample(range(k, 500), rng.choice((1, 2, 3)))):
            value = 1e15 if k == 9 and not rows[-1][2] == date else level + rng.gauss(0, 1)
            rows.append(("A", "x", date, value, "S1", "s", dt.datetime(2000, 1, 1) + dt.timedelta(days=loaded), len(rows)))
    found = {r.as_of: r for r in trailing_zscore_grid(spark.createDataFrame(rows, SCHEMA), grid, 200, 3, PRIORITY, grid).collect()}
    checked = 0
    for g in grid:
        inside = {d: by for d, by in _known(rows, g, _midnight(g)).get(("A", "x"), {}).items() if d >= g - dt.timedelta(days=200)}
        values = np.array([v for by in inside.values() for v in by.values()])
        if len(values) < 3:
            assert g not in found or found[g].z is None
            continue
        assert found[g].n_obs == len(values)
        if values.max() < 1e14:  # the outlier has not come or has gone, and leaves nothing behind
            checked += 1
            off = values - values.mean()
            assert found[g].z == pytest.approx((_pick(inside[max(inside)]) - values.mean()) / np.sqrt(np.mean(off * off)), rel=1e-6, abs=1e-6)
    assert checked > 50


def test_rows_of_a_score_grow_with_the_grid_times_its_logarithm(spark):
    """As many intervals as there are pairs of dates: none is repeated over its dates."""
    blocks = spark.range(64).crossJoin(spark.range(1, 65).withColumnRenamed("id", "after")).where("id < after")
    cut = blocks.select(F.inline(aligned_ranges(F.col("id").cast("int"), F.col("after").cast("int"), 64)))
    assert cut.distinct().count() == 2 * 64 - 1
    repeated = cut.distinct().agg(F.sum(F.expr("shiftleft(1, _level)"))).first()[0]
    assert repeated == 64 * 7  # one range a level around each slot; the blocks themselves hold 45,760 slots


def test_a_plan_without_pairs(log):
    plan = asof_vintages(log, GRID, GRID, [90])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2


def test_what_a_log_cannot_answer(log):
    with pytest.raises(ValueError, match="known_by"):
        replay(log, GRID[0], GRID[-1], known_by="as_of")
    with pytest.raises(ValueError, match="'as_of' when a word"):
        replay(log, GRID[0], GRID[-1], known_by="now")
    with pytest.raises(ValueError, match="one load time per grid date"):
        asof_vintages(log, GRID, GRID[1:])
    with pytest.raises(ValueError, match="must not fall"):
        asof_vintages(log, GRID, GRID[::-1])


def test_equal_spans_give_the_expanding_quantiles(spark, rows):
    """A log that was never revised and is loaded at once is a plain panel."""
    table = _final(spark, rows)
    plain = expanding_quantiles(table, GRID, [0.25, 0.9], 2)
    known = vintage_quantiles(table.withColumn("fetched_at", F.lit(None).cast("timestamp")), GRID, GRID, [0.25, 0.9], 2)
    assert sorted(map(str, known.collect())) == sorted(map(str, plain.collect()))
