"""Every registered query against its SQL counterpart, on the smallest tables."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from bindings import panel
from bindings.compare import difference, oracle_connection
from bindings.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


def test_every_counterpart_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert not set(QUERIES) - set(oracle_sql())


def test_entry(spark, sf_dir):
    rows = entry(spark).collect()
    assert len(rows) == 25 and {r.st_stage for r in rows} <= {0, 1, 2, 3, 4}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert difference(spark, con, name, sf_dir) is None


def test_reasons_are_given_for_every_vote(spark, sf_dir):
    rows = queries()["vote_reasons"](spark, sf_dir)
    assert rows.where("summary IS NULL OR st_reasons LIKE '%null%' OR lt_reasons LIKE '%null%'").count() == 0


def test_customer_snapshot_is_shuffled_no_more_than_its_landing(spark, sf_dir):
    """The landed panel lies by customer, so the snapshot and the replay read it without a shuffle."""
    for name in ("feature_snapshot_customers", "regime_replay_customers"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan, name


def test_buckets_of_the_customers_follow_the_orders(spark, sf_dir, monkeypatch):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    monkeypatch.setattr(panel, "ORDERS_PER_BUCKET", 10)
    assert panel.customer_buckets(spark, sf_dir) == -(-orders // 10)


def test_landing_keeps_what_an_entity_is_dealt_by(spark, sf_dir):
    """Rows per indicator come from the wide ones in place: one shuffle by customer from sums to buckets."""
    frame = panel.monthly_panel(spark, sf_dir, "customer", partitions=7).repartition(7, "entity")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(entity#\d+, \d+\)", plan)) == 1
    assert frame.count() == panel.monthly_panel(spark, sf_dir, "customer").count() > 0
