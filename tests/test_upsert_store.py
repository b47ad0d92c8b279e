"""Upserts against a row-by-row model, the tables, batch loads and audits."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelcycle.operators import audit
from panelcycle.operators.asof import latest_at
from panelcycle.operators.series import display_tails, history, percent_change, series_change, series_summary, tail_rows, year_over_year, year_over_year_calendar
from panelcycle.operators.snapshot import feature_snapshots
from panelcycle.operators.upsert import merge_observations, upsert_counts
from panelcycle.plans.load import load_batch, summary_by_entity
from panelcycle.schema import LONG_COLUMNS, OBSERVATION_SCHEMA, PANEL
from panelcycle.sources import tables
from panelcycle.sources.tables import ObservationTable
from tests.conftest import day, months

AT = dt.datetime(2026, 1, 1)


def batch(spark, rows):
    schema = "entity string, indicator string, date date, value double, source string, series_id string, fetched_at timestamp, arrival bigint"
    return spark.createDataFrame([(*r, AT, i) for i, r in enumerate(rows)], schema)


def model(stored: dict, rows):
    """What a row-at-a-time upsert does."""
    table, inserted, skipped = dict(stored), 0, 0
    for e, i, d, v, s, sid in rows:
        key = (e, i, d, s)
        if key not in table:
            table[key] = (v, sid)
            inserted += 1
        elif table[key][0] != v:
            table[key] = (v, table[key][1])
            inserted += 1
        else:
            skipped += 1
    return table, inserted, skipped


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_upsert_equals_the_row_by_row_model(spark, bits):
    """Half the batch revises one single key; stretches of 1, 4 and 2**20 rows must agree."""
    rng = random.Random(bits)
    keys = [("US", "x", day("2020-01-01") + dt.timedelta(days=k), "S") for k in range(6)]
    stored_rows = [(*k[:3], float(n), k[3], "OLD") for n, k in enumerate(keys[:4])]
    rows = []
    for n in range(60):
        k = keys[0] if n % 2 else rng.choice(keys)
        rows.append((*k[:3], float(rng.randrange(3)), k[3], f"B{n}"))
    stored = {(r[0], r[1], r[2], r[4]): (r[3], r[5]) for r in stored_rows}
    table, inserted, skipped = model(stored, rows)
    target = batch(spark, stored_rows).drop("arrival")
    merged = merge_observations(target, batch(spark, rows), "arrival", stretch_bits=bits)
    assert {(r.entity, r.indicator, r.date, r.source): (r.value, r.series_id) for r in merged.collect()} == table
    counts = upsert_counts(merged, ["entity"]).first()
    assert (counts.inserted, counts.skipped, counts.rows) == (inserted, skipped, 60)
    assert counts.new == len(table) - 4 and counts.inserted == counts.new + counts.changed


@pytest.fixture
def store(spark, tmp_path):
    return ObservationTable(spark, str(tmp_path / "obs"))


def test_store_keeps_first_stamp_and_last_value(spark, store):
    assert store.read().count() == 0
    first = [("US", "policy_rate", day("2026-04-01"), 4.33, "FRED", "DFF"), ("US", "policy_rate", day("2026-04-01"), 4.3, "BIS", "B"),
             ("US", "cpi_yoy", day("2025-04-01"), 3.0, "FRED", "C")]
    counts = {r.indicator: (r.inserted, r.skipped) for r in store.upsert(batch(spark, first), "arrival").collect()}
    assert counts == {"policy_rate": (2, 0), "cpi_yoy": (1, 0)}
    revised = [("US", "policy_rate", day("2026-04-01"), 4.5, "FRED", "NEW"), ("US", "policy_rate", day("2026-05-01"), 4.6, "FRED", "DFF")]
    counts = store.upsert(batch(spark, revised), "arrival").first()
    assert (counts.new, counts.changed, counts.skipped) == (1, 1, 0)
    rows = {(r.date, r.source): (r.value, r.series_id) for r in store.read(["policy_rate"]).collect()}
    assert rows == {(day("2026-04-01"), "FRED"): (4.5, "DFF"), (day("2026-04-01"), "BIS"): (4.3, "B"), (day("2026-05-01"), "FRED"): (4.6, "DFF")}
    assert store.read(until=day("2025-12-31")).count() == 1 and store.read().schema.names == OBSERVATION_SCHEMA.names
    again = store.upsert(batch(spark, revised), "arrival").first()
    assert (again.inserted, again.skipped) == (0, 2) and store.read().count() == 4


def test_store_prunes_folders(spark, store):
    store.upsert(batch(spark, [("US", i, d, 1.0, "S", "s") for i in ("a", "b") for d in months("2020-01-01", 30)]), "arrival")
    plan = store.read(["a"], until=day("2020-06-30"))._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "indicator" in filters.split("PushedFilters")[0] and "obs_year" in filters.split("PushedFilters")[0]
    assert "LessThanOrEqual(date" in filters


def test_an_upsert_replaces_the_folders_it_touches_alone(spark, store):
    rows = [("US", i, d, 1.0, "S", "s") for i in ("a/b", "c=d") for d in months("2020-01-01", 14)]
    store.upsert(batch(spark, rows), "arrival")

    def files():
        return set(store.read()._jdf.inputFiles())

    before = files()
    revised = batch(spark, [("US", "c=d", day("2021-01-01"), 2.0, "S", "s"), ("US", "e", day("2021-01-01"), 3.0, "S", "s")])
    store.upsert(revised, "arrival")
    assert store.read().groupBy("value").count().orderBy("value").collect() == [(1.0, 27), (2.0, 1), (3.0, 1)]
    assert store.read(["a/b"]).count() == 14 and len(before & files()) == 3 and len(files()) == 5
    again = store.upsert(revised, "arrival").agg(F.sum("inserted").alias("n")).first()
    assert again.n == 0 and store.read().count() == 29


def test_many_touched_folders_are_found_by_a_join(spark, store, monkeypatch):
    rows = [("US", i, day(f"{y}-03-01"), 1.0, "S", "s") for i in "abc" for y in range(2000, 2006)]
    store.upsert(batch(spark, rows), "arrival")
    monkeypatch.setattr(tables, "LITERAL_FOLDERS", 2)
    store.upsert(batch(spark, [("US", "a", day(f"{y}-03-01"), 2.0, "S", "s") for y in range(2000, 2005)]), "arrival")
    assert store.read().groupBy("value").count().orderBy("value").collect() == [(1.0, 13), (2.0, 5)]


def test_a_batch_that_does_not_repeat_itself(spark, store):
    kept = [(f"E{k}", "a", day(f"{y}-01-01"), 1.0, "S", "s") for k in range(9) for y in range(2000, 2006)]
    store.upsert(batch(spark, kept), "arrival")
    drawn = batch(spark, [(f"E{k}", "a", day("2000-01-01"), 2.0, "S", "s") for k in range(9)]).withColumn(
        "date", F.add_months("date", 12 * F.floor(F.rand() * 6).cast("int"))
    )
    counts = store.upsert(drawn).agg(F.sum("changed").alias("n")).first()
    assert counts.n == 9 and store.read().count() == len(kept) and store.read().where("value = 2").count() == 9


@pytest.fixture
def bucketed(spark, tmp_path):
    rows = [(f"E{k}", i, d, float(k), s, "s") for k in range(20) for i in ("cpi_yoy", "policy_rate") for d in months("2020-01-01", 20) for s in "PQ"]
    panel = batch(spark, rows).drop("arrival")
    yield panel, tables.save_bucketed(panel, "bucketed_panel", 4, str(tmp_path / "bucketed"))
    spark.sql("DROP TABLE bucketed_panel")


def test_a_bucketed_table_needs_no_exchange(spark, bucketed, monkeypatch):
    """As-of and snapshot, with canonical pick, lags and widening, stay inside the buckets."""
    panel, stored = bucketed
    grid = [day("2020-06-30"), day("2021-06-30")]
    latest, wide = latest_at(stored, grid[0]), feature_snapshots(stored, grid, colocated=True)
    for frame in (latest, wide):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan
    assert sorted(map(str, latest.collect())) == sorted(map(str, latest_at(panel, grid[0]).collect()))
    assert sorted(map(str, wide.collect())) == sorted(map(str, feature_snapshots(panel, grid).collect()))
    assert "Exchange hashpartitioning" in feature_snapshots(panel, grid)._jdf.queryExecution().executedPlan().toString()


def test_one_bad_series_never_stops_the_batch(spark, store):
    good = [("US", "a", d, 1.0, "S", "s", None) for d in months("2020-01-01", 3)]
    bad = [("US", "b", day("2020-01-01"), 1.0, "S", "s", None), ("US", "b", None, 1.0, "S", "s", "period out of range: 2020-M13")]
    parsed = spark.createDataFrame(good + bad, "entity string, indicator string, date date, value double, source string, series_id string, error string")
    specs = spark.createDataFrame([("US", "a"), ("US", "b"), ("SE", "a")], "entity string, indicator string")
    summary = load_batch(store, parsed, specs)
    rows = {(r.entity, r.indicator): (r.rows, r.inserted, r.error) for r in summary.collect()}
    assert rows == {("US", "a"): (3, 3, None), ("US", "b"): (None, None, "period out of range: 2020-M13"), ("SE", "a"): (0, 0, None)}
    assert store.read().count() == 3
    by_entity = [(r.entity, r.n_series, r.n_failed, r.inserted) for r in summary_by_entity(summary).collect()]
    assert by_entity == [("SE", 1, 0, 0), ("US", 2, 1, 3)]


def test_strays_and_faults_go_to_the_quarantine(spark, store, tmp_path):
    rows = [("US", "a", day("2020-01-01"), 1.0, "S", "s", None), ("US", "b", day("2020-01-01"), 1.0, "S", "s", None),
            ("US", "b", None, None, "S", "s", "not a number: x"), (None, None, None, None, None, "stray", "no spec for this file")]
    parsed = spark.createDataFrame(rows, "entity string, indicator string, date date, value double, source string, series_id string, error string")
    specs = spark.createDataFrame([("US", "a"), ("US", "b")], "entity string, indicator string")
    summary = load_batch(store, parsed, specs, quarantine_path=str(tmp_path / "q")).collect()
    assert {(r.entity, r.indicator, r.rows, r.error) for r in summary} == {
        ("US", "a", 1, None), ("US", "b", None, "not a number: x"), (None, None, None, "no spec for this file")}
    assert store.read().count() == 1
    assert {r.error for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {"not a number: x", "no spec for this file"}


def test_freshness(spark):
    today = day("2026-01-01")
    specs = spark.createDataFrame([("OLD", "raw"), ("YEAR", "raw"), ("NEW", "raw"), ("X657S", "yoy"), ("NONE", "raw")], "series_id string, transform string")
    ages = {"OLD": 731, "YEAR": 366, "NEW": 10, "X657S": 800}
    raw = spark.createDataFrame([(s, today - dt.timedelta(days=a + k), float(k)) for s, a in ages.items() for k in (0, 5)], "series_id string, date date, value double")
    notes = {r.series_id: r.notes for r in audit.freshness(specs, raw, today).collect()}
    assert notes == {"OLD": "STALE >2y", "YEAR": "stale >1y", "NEW": "ok", "X657S": "STALE >2y; BUG: 657/659 already YoY", "NONE": "EMPTY"}
    ids = spark.createDataFrame([("NEW",), ("NEW",), ("OLD",)], "series_id string")
    assert [(r.series_id, r.age_days, r["sample"]) for r in audit.fresh_candidates(raw, today, ids).collect()] == [("NEW", 10, 0.0)]
    assert audit.candidates(raw, today, ids).count() == 2


# ---- series operators

def test_positional_and_calendar_growth_differ_at_a_gap(panel_of):
    days = months("2020-01-01", 26)
    panel = panel_of([("A", "x", d, 100.0 + i) for i, d in enumerate(days) if i != 5])
    positional = {r.date: r.value for r in year_over_year(panel, "M").collect()}
    on_calendar = {r.date: r.value for r in year_over_year_calendar(panel).collect()}
    assert len(positional) == 13 and len(on_calendar) == 13
    assert days[17] in positional and days[17] not in on_calendar
    assert on_calendar[days[20]] == pytest.approx((120 / 108 - 1) * 100)
    assert positional[days[14]] == pytest.approx((114 / 101 - 1) * 100)  # the gap moves the base
    assert on_calendar[days[14]] == pytest.approx((114 / 102 - 1) * 100)
    assert positional[days[20]] == pytest.approx((120 / 108 - 1) * 100)
    with pytest.raises(ValueError, match="frequency 'D'"):
        year_over_year(panel, "D")


def test_sources_of_one_day_do_not_mix(spark):
    days = months("2020-01-01", 18)
    rows = [("A", "x", d, v + i, s, "id") for i, d in enumerate(days) for s, v in (("P", 100.0), ("Q", 900.0))]
    panel = spark.createDataFrame(rows, "entity string, indicator string, date date, value double, source string, series_id string")
    alone = year_over_year(panel.where("source = 'P'"), "M").select("date", "value").collect()
    assert sorted(year_over_year(panel, "M").where("source = 'P'").select("date", "value").collect()) == sorted(alone)
    assert year_over_year(panel, "M").count() == year_over_year_calendar(panel).count() == 12
    for order, base in ((["P", "Q"], 100.0), (["Q", "P"], 900.0)):
        change = series_change(panel, priority=order).first()
        assert (change.first_value, change.last_value, change.change) == (base, base + 17, 17.0)
        assert [(r.date, r.source) for r in tail_rows(panel, 1, priority=order).collect()] == [(days[-1], order[0])]


def test_growth_on_a_zero_base(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (5.0, None), (None, 5.0)], "v double, b double")
    found = [r.g for r in rows.select(percent_change(F.col("v"), F.col("b")).alias("g")).collect()]
    assert found == [float("inf"), float("-inf"), None, None, None]


def test_tails_summaries_and_changes(panel_of):
    days = months("2020-01-01", 30)
    panel = panel_of([("A", i, d, float(n)) for i in ("policy_rate", "cpi_yoy") for n, d in enumerate(days)])
    assert {r.value for r in tail_rows(panel.where("indicator = 'cpi_yoy'"), 3).collect()} == {27.0, 28.0, 29.0}
    tails = display_tails(panel, {"policy_rate": 5, "cpi_yoy": 2}).groupBy("indicator").count().collect()
    assert {r.indicator: r["count"] for r in tails} == {"policy_rate": 5, "cpi_yoy": 2}
    summary = series_summary(panel).where("indicator = 'cpi_yoy'").first()
    assert (summary.n_obs, summary.first_date, summary.last_date) == (30, days[0], days[-1])
    change = series_change(panel).first()
    assert (change.first_value, change.last_value, change.change, change.last_year, change.last_quarter) == (0.0, 29.0, 29.0, 2022, 2)
    assert [r.value for r in history(panel, "A", "cpi_yoy").limit(2).collect()] == [0.0, 1.0]


def test_long_columns_are_the_schema():
    assert LONG_COLUMNS == OBSERVATION_SCHEMA.names[:6] and PANEL.natural_key == ["entity", "indicator", "date", "source"]
