"""As-of on timestamps: slots, grids, blocks of time and lags against loops."""

from __future__ import annotations

import datetime as dt
import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from panelcycle.operators.asof_time import _block, asof_time_grid, asof_time_join, hourly_grid, with_time_lags
from panelcycle.operators.slots import first_slot, with_first_slot
from panelcycle.schema import PanelColumns

START = dt.datetime(2024, 1, 1)
COLS = PanelColumns(entity=("site", "sensor"), date="at")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 1000, 20_000])
@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_slots_by_binary_search(spark, size, kind):
    step = dt.timedelta(days=2) if kind == "date" else dt.timedelta(minutes=7, microseconds=3)
    first = START.date() if kind == "date" else START
    grid = [first + k * step for k in range(size)]
    rng = random.Random(size)
    unit = dt.timedelta(days=1) if kind == "date" else dt.timedelta(microseconds=1)
    asked = [first - unit, grid[-1], grid[-1] + unit, grid[size // 2], None, *[rng.choice(grid) + rng.choice((-unit, 0 * unit, unit)) for _ in range(60)]]
    frame = spark.createDataFrame([(None if a is None else str(a),) for a in asked], "a string").select(F.col("a").cast(kind).alias("a"))
    found = [r.slot for r in with_first_slot(frame, "a", grid).collect()]
    assert found == [None if a is None else bisect_left(grid, a) for a in asked]


def test_a_slot_is_a_constant_array_and_no_join(spark):
    plan = spark.range(3).select(first_slot(F.timestamp_micros("id"), hourly_grid(START, START + dt.timedelta(days=400)), "timestamp").alias("s"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "split(" not in text


def _rows(n=3000):
    rng = random.Random(6)
    out = []
    for k in range(n):
        hot = k % 3 == 0
        at = START + dt.timedelta(seconds=rng.randrange(0, 10 * 86400, 30))
        out.append(("HOT" if hot else rng.choice("AB"), None if k % 50 == 1 else "s", "x", at, float(k), k))
    return out


@pytest.fixture(scope="module")
def rows():
    return _rows()


@pytest.fixture(scope="module", params=["timestamp_ntz", "timestamp"])
def observations(spark, rows, request):
    schema = f"site string, sensor string, indicator string, at {request.param}, value double, seq long"
    plain = spark.createDataFrame([(*r[:3], str(r[3]), *r[4:]) for r in rows], schema.replace(request.param, "string"))
    return plain.withColumn("at", F.col("at").cast(request.param)).repartition(4)


def _newest(rows, key, at):
    seen = [r for r in rows if r[:3] == key and r[3] <= at]
    return max(seen, key=lambda r: (r[3], r[5])) if seen else None


def test_a_grid_of_hours(rows, observations):
    grid = hourly_grid(START - dt.timedelta(hours=1), START + dt.timedelta(days=9), dt.timedelta(hours=3))
    found = asof_time_grid(observations, grid, ["seq"], COLS).collect()
    told = {(r.site, r.sensor, r.indicator, r.as_of): (r.value, r.observed_at) for r in found}
    assert len(told) == len(found)
    keys = {r[:3] for r in rows}
    expected = {(*k, g): _newest(rows, k, g) for k in keys for g in grid}
    assert told == {k: (r[4], r[3]) for k, r in expected.items() if r}


@pytest.mark.parametrize("block", [dt.timedelta(minutes=20), dt.timedelta(hours=7), dt.timedelta(days=30)])
def test_probes_in_blocks(spark, rows, observations, block):
    """Some blocks have no row, some probes lie before and after all rows, some repeat."""
    kind = observations.schema["at"].dataType.simpleString()
    rng = random.Random(1)
    probes = [(rng.choice(("HOT", "A", "B", "NONE")), "s", "x", START + dt.timedelta(seconds=rng.randrange(-9000, 11 * 86400)), k) for k in range(300)]
    probes += [(*probes[0][:4], 900), ("HOT", "s", "x", rows[0][3], 901), ("HOT", "s", "x", None, 902), ("A", None, "x", START, 903)]
    frame = spark.createDataFrame([(*p[:3], None if p[3] is None else str(p[3]), p[4]) for p in probes], "site string, sensor string, indicator string, as_of string, id long")
    found = asof_time_join(frame.withColumn("as_of", F.col("as_of").cast(kind)), observations, "as_of", block, ["seq"], COLS).collect()
    told = {r.id: (r.value, r.observed_at) for r in found}
    assert len(found) == len(probes)
    for p in probes:
        best = None if p[3] is None or p[1] is None else _newest(rows, p[:3], p[3])
        assert told[p[4]] == ((best[4], best[3]) if best else (None, None)), p


def test_lags_by_time(rows, observations):
    usable = observations.where("sensor IS NOT NULL")
    lagged = with_time_lags(usable, {"lag_1h": dt.timedelta(hours=1), "lag_1d": dt.timedelta(days=1)}, dt.timedelta(hours=2), ["seq"], COLS).collect()
    kept = [r for r in rows if r[1] is not None]
    assert len(lagged) == len(kept)
    for r in lagged[:400]:
        for name, distance in (("lag_1h", dt.timedelta(hours=1)), ("lag_1d", dt.timedelta(days=1))):
            best = _newest(kept, (r.site, r.sensor, r.indicator), r["at"] - distance)
            assert r[name] == (best[4] if best else None)


def test_no_task_orders_a_tenth_of_the_rows(spark, rows, observations):
    """A third of the rows is one series; what is ordered together is one series' block."""
    sizes = observations.withColumn("b", _block(F.col("at"), dt.timedelta(hours=6))).groupBy(*COLS.series_key, "b").count()
    assert sizes.agg(F.max("count")).first()[0] < len(rows) / 10 < sum(r[0] == "HOT" for r in rows) / 3
    probes = observations.select(*COLS.series_key, F.col("at").alias("as_of"))
    plan = asof_time_join(probes, observations, "as_of", dt.timedelta(hours=6), ["seq"], COLS)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_block" in line for line in windows)
    assert "_row" in next(w for w in windows if "_side" in w) and "_block#" in next(w for w in windows if "_side" in w).split("], [")[1]
