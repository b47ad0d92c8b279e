"""The physical plans: what is pushed down, what is shuffled, and what hot keys do."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from panelcycle.operators.asof import asof_grid, latest_at, slot_of
from panelcycle.operators.canonical import canonical_panel
from panelcycle.operators.series import tail_rows
from panelcycle.operators.snapshot import feature_snapshots
from panelcycle.operators.tilts import asset_tilts, explode_tilts, top_tilts
from panelcycle.plans.classify import classify
from panelcycle.schema import OBSERVATION_SCHEMA

GRID = [dt.date(2000, 1, 1), dt.date(2001, 1, 1), dt.date(2002, 1, 1)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A third of all rows belong to one series, and its days come from many sources."""
    path = str(tmp_path_factory.mktemp("panel") / "p")
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("E"), F.col("id") % 40)).alias("entity"),
        F.when(F.col("id") % 2 == 0, "cpi_yoy").otherwise("policy_rate").alias("indicator"),
        F.date_add(F.lit(dt.date(1999, 1, 1)), (F.col("id") % 900).cast("int")).alias("date"),
        (F.col("id") % 101).cast("double").alias("value"),
        F.concat(F.lit("S"), F.col("id") % 17).alias("source"),
        F.lit("s").alias("series_id"), F.lit(None).cast("timestamp").alias("fetched_at"),
    ).dropDuplicates(["entity", "indicator", "date", "source"])
    rows.write.parquet(path)
    return spark.read.schema(OBSERVATION_SCHEMA).parquet(path)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


def test_date_bound_and_columns_reach_the_scan(stored):
    plan = plan_of(latest_at(stored, dt.date(2000, 6, 30), ("S1",)))
    assert "LessThanOrEqual(date,2000-06-30)" in plan
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "series_id" not in schema and "fetched_at" not in schema
    assert "SortAggregate" not in plan and plan.count("HashAggregate") == 2


def test_indicators_reach_the_scan(stored):
    plan = plan_of(feature_snapshots(stored, GRID))
    assert "In(indicator" in plan


def test_a_snapshot_shuffles_by_day_and_by_entity_only(spark, stored):
    keys = [re.sub(r"#\d+", "", k).split(", ") for k in shuffles(feature_snapshots(stored, GRID))]
    assert [k[:-1] if k[-1].isdigit() else k for k in keys] == [["entity"], ["entity", "indicator", "date"]]
    one_source = shuffles(feature_snapshots(stored, GRID, one_row_per_day=True))
    assert len(one_source) == 1


def test_no_cross_joins_or_sort_aggregates(spark, stored):
    entities = stored.select("entity").distinct()
    plan = plan_of(asset_tilts(classify(stored, GRID, entities=entities, with_reasons=False), with_reasons=False))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "SortAggregate" not in plan
    assert "Python" not in plan


def test_tilts_are_expanded_in_place(stored):
    classified = classify(stored, GRID, thresholds=None, signal_asof="none", with_reasons=False)
    base = len(shuffles(classified))
    assert len(shuffles(explode_tilts(asset_tilts(classified, with_reasons=False), ["entity", "as_of"]))) == base
    best = top_tilts(asset_tilts(classified, with_reasons=False), ["entity", "as_of"])
    assert len(shuffles(best)) == base
    # no generator filter is copied below the projections
    assert len(best._jdf.queryExecution().optimizedPlan().toString()) < 80_000


def test_tail_limit_is_applied_before_the_shuffle(stored):
    plan = plan_of(tail_rows(stored, 5))
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_copies_of_a_day_collapse_before_the_series_is_walked(stored):
    """The hot series' rows per day, from 17 sources, are one row once its days are ordered."""
    daily = canonical_panel(stored, ("S3", "S1"))
    largest = daily.groupBy("entity", "indicator").count().agg(F.max("count")).first()[0]
    assert largest <= 900 < stored.where("entity = 'HOT'").count() / 2
    plan = plan_of(daily)
    assert plan.index("functions=[min_by") < plan.index("Exchange") < plan.index("functions=[partial_min_by")


def test_slots_hold_the_first_grid_date_that_sees_a_row(spark):
    days = spark.createDataFrame([(d,) for d in (dt.date(1990, 5, 5), GRID[0], dt.date(2000, 1, 2), GRID[1], dt.date(2001, 7, 1), GRID[2], dt.date(2003, 1, 1))], "date date")
    assert [r.slot for r in slot_of(days, GRID).orderBy("date").collect()] == [0, 0, 1, 1, 2, 2]


def test_grid_asof_of_the_hot_series(stored):
    found = {(r.entity, r.indicator): r.observed_on for r in asof_grid(stored, GRID).where(F.col("as_of") == F.lit(GRID[-1])).collect()}
    expected = {(r.entity, r.indicator): r.d for r in stored.groupBy("entity", "indicator").agg(F.max("date").alias("d")).collect()}
    assert found == expected


@pytest.mark.parametrize("how, scans, exchanges", [("calibrated", 3, 5), ("expanding", 3, 6)])
def test_a_default_classification_reads_and_shuffles_little(stored, how, scans, exchanges):
    """Ordinary series are counted before, so the plan has no way for larger ones."""
    plan = plan_of(classify(stored, GRID, thresholds=how))
    assert plan.count("FileScan") <= scans
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= exchanges
