"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is consumed in full by the no-op sink. The panels are landed once, as their own
entries. With BENCH_COMPARE=1, ``comparisons`` also times the chosen plans against their obvious
alternatives (two more minutes).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from bindings.panel import REPLAY_END, REPLAY_START, TODAY, grid_dates, landed_panel
from bindings.queries import QUERIES
from panelcycle.operators.asof import asof_grid
from panelcycle.plans.replay import replay
from panelcycle.session import local_session

HEADLINE = (
    "short_term_stage", "feature_snapshot", "feature_snapshot_customers", "regime_replay", "regime_replay_point_in_time",
    "regime_replay_customers", "asset_tilt_table", "world_basket", "entity_thresholds", "expanding_entity_thresholds", "series_quantiles_large",
    "asof_over_grid", "asof_probe_join", "anchor_lags", "trailing_zscores_on_grid", "upsert_merge", "store_round_trip",
    "yoy_positional", "series_freshness", "asof_by_vintage", "asof_hourly", "expanding_quantile_table", "viewer_tilt_table",
)


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def range_join_asof(panel, grid):
    """The alternative: pair every observation with every later grid date, keep the newest."""
    dates = panel.sparkSession.createDataFrame([(d,) for d in grid], "as_of date")
    paired = panel.join(F.broadcast(dates), F.col("date") <= F.col("as_of"))
    return paired.groupBy("entity", "indicator", "as_of").agg(
        F.max_by("value", "date").alias("value"), F.max("date").alias("observed_on")
    )


def replay_per_date(panel, grid):
    """The alternative: one job per date."""
    for day in grid:
        consume(replay(panel, day, day, "Q", TODAY, signal_asof="none", one_row_per_day=True))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1).count()  # the JVM's start is not the landing's
    seconds = {
        "land_nation_panel": timed(lambda: landed_panel(spark, sf_dir)),
        "land_customer_panel": timed(lambda: landed_panel(spark, sf_dir, "customer")),
    }
    for name in HEADLINE:
        seconds[name] = timed(lambda: consume(QUERIES[name](spark, sf_dir)))
    seconds["regime_replay_default_plan"] = timed(
        lambda: consume(replay(landed_panel(spark, sf_dir), REPLAY_START, REPLAY_END, "Q", TODAY))
    )
    nation, customer = landed_panel(spark, sf_dir), landed_panel(spark, sf_dir, "customer")
    comparisons = {}
    # in short on the nations and four dates; BENCH_COMPARE=1 takes all dates and the customers too
    full = os.environ.get("BENCH_COMPARE") == "1"
    grid = grid_dates() if full else grid_dates()[-4:]
    for label, panel in (("nations", nation), ("customers", customer)) if full else (("nations", nation),):
        slots = timed(lambda: consume(asof_grid(panel, grid, one_row_per_day=True)))
        pairs = timed(lambda: consume(range_join_asof(panel, grid)))
        comparisons[f"asof_{label}"] = {"slots": slots, "range_join": pairs}
        one = timed(lambda: consume(replay(panel, grid[0], grid[-1], "Q", TODAY, signal_asof="none", one_row_per_day=True)))
        many = timed(lambda: replay_per_date(panel, grid))
        comparisons[f"replay_{label}"] = {"one_job": one, "job_per_date": many}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "comparisons": comparisons,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
