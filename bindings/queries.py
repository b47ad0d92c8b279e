"""One query per operator, over the given tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.panel import (
    AS_OF,
    HOME_CURRENCY,
    HOMES,
    INDICATORS,
    REPLAY_END,
    REPLAY_START,
    SIGNAL_ENTITIES,
    TODAY,
    customer_buckets,
    daily_panel,
    grid_dates,
    hundredths,
    landed_panel,
    monthly_panel,
    monthly_wide,
    sourced_panel,
    table,
)
from panelcycle.catalog.indicators import ALL_INDICATORS, LAGGED_FEATURES
from panelcycle.catalog.thresholds import CALIBRATION_QUANTILES, DEFAULT_THRESHOLDS, MIN_OBSERVATIONS
from panelcycle.functions import periods, scalars
from panelcycle.functions.scalars import DERIVED_FEATURES
from panelcycle.operators import audit, membership, series
from panelcycle.operators.asof import asof_grid, asof_join, latest_at, with_anchor_lags
from panelcycle.operators.asof_time import asof_time_grid, asof_time_join, hourly_grid, with_time_lags
from panelcycle.operators.canonical import canonical_panel, duplicate_keys
from panelcycle.operators.quantiles import expanding_quantiles, series_quantiles
from panelcycle.operators.rules import LONG_TERM_RULES, SHORT_TERM_RULES, Rule, RuleSet, case, text
from panelcycle.operators.signals import credit_signal, trailing_zscore, trailing_zscore_grid
from panelcycle.operators.snapshot import feature_snapshots, with_derived_features
from panelcycle.operators.thresholds import calibrated_thresholds, expanding_thresholds, threshold_deltas, with_thresholds
from panelcycle.operators.tilts import asset_tilts, explode_tilts, rank_long_tilts, top_tilts
from panelcycle.operators.upsert import merge_observations, upsert_counts
from panelcycle.operators.vintages import asof_vintages
from panelcycle.operators.votes import cast_votes, long_votes
from panelcycle.plans import load
from panelcycle.plans.classify import attach_signal, classify
from panelcycle.plans.replay import date_grid, entities_with_a_path, replay
from panelcycle.plans.views import entity_views, home_real_rates, viewer_views, world_view
from panelcycle.schema import OBSERVATION_SCHEMA, PanelColumns
from panelcycle.session import ensure_checkpoint_dir
from panelcycle.sources.provider_series import faulty_specs, land_series
from panelcycle.sources.sdmx_csv import parse_sdmx
from panelcycle.sources.sdmx_xml import parse_sdmx_xml
from panelcycle.sources.tables import ObservationTable, save_bucketed
from panelcycle.sources.worldbank import parse_worldbank_json

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SOURCE_PRIORITY = ("ALT", "STAR")  # of the panel of three sources
PRIORITY = ("N", "R", "A")  # sources of the daily panel, best first
ASKED_CODES = ["nation_3", "Nation_7", "REGION_1", "nation_24"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str, alias: str | None = None) -> Column:
    """Six decimals, without a negative zero."""
    return (F.round(F.col(column), 6) + F.lit(0.0)).alias(alias or column)


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("entity"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("iso3"),
        F.concat(F.lit("Nation "), F.col("n_nationkey")).alias("name"), "n_nationkey", "n_regionkey",
    )


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(
        nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return table(spark, sf_dir, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey"))


# ---- scans, sources, sinks ------------------------------------------------------------------

@query
def history_scan(spark, sf_dir):
    return series.history(landed_panel(spark, sf_dir), "NATION_3", "cpi_yoy").select("date", r6("value"))


@query
def entity_presence(spark, sf_dir):
    names = nations(spark, sf_dir).select("entity").unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("entity"))
    )
    flagged = membership.flag_presence(names, landed_panel(spark, sf_dir))
    return flagged.select("entity", F.col("has_data").cast("int").alias("has_data"))


@query
def available_indicators(spark, sf_dir):
    catalogue = [*INDICATORS, "never_landed"]
    return membership.available_indicators(landed_panel(spark, sf_dir), catalogue)


def _csv_rows(spark, sf_dir) -> DataFrame:
    """Orders as raw CSV fields: five period forms by priority, missing marks by status."""
    year, month = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM")
    priority = F.col("o_orderpriority")
    period = (
        F.when(priority == "1-URGENT", F.concat(year, F.lit("-Q"), F.quarter("o_orderdate")))
        .when(priority == "2-HIGH", F.concat(year, F.lit("-M"), month))
        .when(priority == "3-MEDIUM", year)
        .when(priority == "5-LOW", F.concat(year, F.lit("-M"), (F.month("o_orderdate") + 6).cast("string")))
        .otherwise(F.concat(year, F.lit("/"), month))
    )
    value = F.when(F.col("o_orderstatus") == "P", F.lit("NaN")).otherwise(hundredths("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("entity"), priority.alias("indicator"), F.lit("CSV").alias("source"),
        F.lit("Q.US.C").alias("series_id"), period.alias("TIME_PERIOD"), value.alias("OBS_VALUE"),
    )


@query
def sdmx_csv_rows(spark, sf_dir):
    parsed = parse_sdmx(_csv_rows(spark, sf_dir))
    return parsed.groupBy("entity", "indicator", "date").agg(
        F.count_if(F.col("error").isNull()).alias("n_rows"),
        F.count_if(F.col("error").isNotNull()).alias("n_faults"),
        F.sum(F.when(F.col("error").isNull(), F.col("value"))).alias("total"),
    )


def _specs(spark, sf_dir) -> DataFrame:
    region = F.col("n_regionkey")
    return nations(spark, sf_dir).select(
        F.concat(F.lit("SALES."), F.col("entity")).alias("series_id"), "entity", F.lit("sales").alias("indicator"),
        F.when(region == 2, "Q").when(region == 3, "A").when(region == 4, "D").otherwise("M").alias("frequency"),
        F.when(region == 0, "raw").otherwise("yoy").alias("transform"),
    )


def _sales(spark, sf_dir) -> DataFrame:
    return monthly_wide(spark, sf_dir).select(
        F.concat(F.lit("SALES."), F.col("entity")).alias("series_id"), "date", F.col("price").alias("value")
    )


@query
def provider_series(spark, sf_dir):
    landed = land_series(_sales(spark, sf_dir), _specs(spark, sf_dir))
    return landed.select("entity", "indicator", "date", r6("value"), "source", "series_id")


@query
def provider_series_faults(spark, sf_dir):
    return faulty_specs(_specs(spark, sf_dir)).select("entity", "series_id", "error")


@query
def worldbank_json_rows(spark, sf_dir):
    yearly = monthly_wide(spark, sf_dir).groupBy("entity", F.year("date").cast("string").alias("y")).agg(
        F.sum("price").alias("v")
    )
    point = F.struct(F.col("y").alias("date"), F.when(F.col("y") != "1998", F.col("v")).alias("value"))
    listed = F.to_json(F.collect_list(point), {"ignoreNullFields": "false"})
    payloads = yearly.groupBy("entity").agg(F.concat(F.lit('[{"page":1},'), listed, F.lit("]")).alias("payload"))
    silent = nations(spark, sf_dir).where(F.col("n_regionkey") == 4).select("entity")
    muted = payloads.join(silent.withColumn("_mute", F.lit(True)), "entity", "left").select(
        "entity", F.when(F.col("_mute"), F.lit('[{"message":[{"id":"120"}]}]')).otherwise(F.col("payload")).alias("payload")
    )
    return parse_worldbank_json(muted).select("entity", "indicator", "date", "value", "source", "series_id", "error")


@query
def sdmx_xml_rows(spark, sf_dir):
    quarterly = monthly_wide(spark, sf_dir).groupBy(
        "entity", F.year("date").alias("y"), F.quarter("date").alias("q")
    ).agg(F.sum("price").cast("bigint").alias("v"))
    period = F.when(F.col("y") == 2001, F.format_string("%d-M%02d", "y", "q")).when(
        F.col("y") == 2000, F.format_string("%d-Q%d", "y", F.col("q") + 2)
    ).otherwise(F.format_string("%d-Q%d", "y", "q"))
    observation = F.format_string('<Obs TIME_PERIOD="%s" OBS_VALUE="%d"/>', period, F.col("v"))
    payloads = quarterly.groupBy("entity").agg(
        F.concat(F.lit("<Series>"), F.concat_ws("\n", F.collect_list(observation)), F.lit("</Series>")).alias("payload")
    )
    stamp = {"indicator": "sales_share", "source": "XML", "series_id": "G001.Q"}
    return parse_sdmx_xml(payloads, stamp=stamp)


def _revisions(spark, sf_dir) -> DataFrame:
    """Orders as revisions of (nation, month, priority), in order-key arrival order."""
    return nation_orders(spark, sf_dir).select(
        "entity", F.lit("order_size").alias("indicator"), F.to_date(F.trunc("o_orderdate", "MM")).alias("date"),
        F.floor(F.col("o_totalprice") / 150000).cast("double").alias("value"),
        F.col("o_orderpriority").alias("source"), F.lit("S").alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").alias("arrival"),
        "o_orderstatus", "iso3",
    )


def _merged(spark, sf_dir) -> DataFrame:
    orders = _revisions(spark, sf_dir)
    stored = orders.where(F.col("o_orderstatus") == "F").groupBy("entity", "indicator", "date", "source").agg(
        F.max("value").alias("value"), F.lit("OLD").alias("series_id"), F.min("fetched_at").alias("fetched_at")
    )
    batch = orders.where(F.col("o_orderstatus") != "F")
    return merge_observations(stored, batch, "arrival")


@query
def upsert_merge(spark, sf_dir):
    return _merged(spark, sf_dir).select(
        "entity", "date", "source", "value", "series_id", "action", "n_inserted", "n_skipped", "n_new", "n_changed"
    )


@query
def upsert_summary(spark, sf_dir):
    return upsert_counts(_merged(spark, sf_dir).where(F.col("action") != "kept"))


def _parsed_orders(spark, sf_dir) -> DataFrame:
    """Series are (nation, priority); periods of partly shipped low-priority orders are broken."""
    broken = (F.col("o_orderstatus") == "P") & (F.col("source") == "5-LOW")
    raw = _revisions(spark, sf_dir).select(
        "entity", F.col("source").alias("indicator"), F.lit("ORD").alias("source"), "series_id", "arrival", "fetched_at",
        F.when(broken, "2001-M13").otherwise(F.date_format("date", "yyyy-'M'MM")).alias("TIME_PERIOD"),
        F.col("value").cast("string").alias("OBS_VALUE"),
    )
    period, value = F.col("TIME_PERIOD"), F.col("OBS_VALUE").try_cast("double")
    return raw.select(
        "entity", "indicator", periods.period_start(period).alias("date"), value.alias("value"), "source", "series_id",
        periods.period_error(period).alias("error"), "arrival", "fetched_at",
    )


def _load_summary(spark, sf_dir) -> DataFrame:
    parsed = _parsed_orders(spark, sf_dir)
    stored = spark.createDataFrame([], OBSERVATION_SCHEMA)
    counts = upsert_counts(merge_observations(stored, load.sound_rows(parsed), "arrival"))
    return load.load_summary(parsed, counts, load.failed_series(parsed))


@query
def load_summary(spark, sf_dir):
    return _load_summary(spark, sf_dir)


@query
def load_summary_by_entity(spark, sf_dir):
    return load.summary_by_entity(_load_summary(spark, sf_dir))


@query
def load_end_to_end(spark, sf_dir):
    """Rows of two providers, faulty specs and series without data, through the load into a table.

    The summary, with the rows then found in the table and in the quarantine.
    """
    import uuid

    specs = _specs(spark, sf_dir)
    growth = land_series(_sales(spark, sf_dir), specs)
    statistics = _parsed_orders(spark, sf_dir)
    parsed = load.with_spec_faults(statistics.unionByName(growth, allowMissingColumns=True), faulty_specs(specs))
    empty = specs.select("entity", F.lit("nothing").alias("indicator"))
    asked = statistics.select("entity", "indicator").unionByName(specs.select("entity", "indicator")).unionByName(empty)
    folder = f"{ensure_checkpoint_dir(spark)}/load-{uuid.uuid4().hex}"
    table_ = ObservationTable(spark, f"{folder}/table")
    summary = load.load_batch(table_, parsed, asked, "arrival", f"{folder}/quarantine")
    keys = ["entity", "indicator"]
    stored = table_.read().groupBy(*keys).agg(F.count(F.lit(1)).alias("stored"))
    held = spark.read.parquet(f"{folder}/quarantine").groupBy(*keys).agg(F.count(F.lit(1)).alias("quarantined"))
    return summary.join(stored, keys, "left").join(held, keys, "left").fillna(0, ["stored", "quarantined"])


def _customer_series(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("series_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "yoy").otherwise("raw").alias("transform"),
    )
    raw = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("series_id"), F.to_date("o_orderdate").alias("date")
    ).agg(F.max("o_totalprice").alias("value"))
    return specs, raw


@query
def series_freshness(spark, sf_dir):
    specs, raw = _customer_series(spark, sf_dir)
    return audit.freshness(specs, raw, TODAY).select("series_id", "transform", "latest", "age_days", "sample", "notes")


@query
def fresh_candidates(spark, sf_dir):
    specs, raw = _customer_series(spark, sf_dir)
    return audit.fresh_candidates(raw, TODAY, specs).select("series_id", "latest", "age_days", "sample")


def _catalogue(spark, sf_dir) -> DataFrame:
    first = nations(spark, sf_dir).select("entity", F.lit("sales").alias("indicator"), F.col("n_nationkey").alias("position"))
    second = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("entity"), F.lit("sales").alias("indicator"), (F.col("r_regionkey") + 25).alias("position")
    )
    return first.unionByName(second)


@query
def catalogue_selection(spark, sf_dir):
    from panelcycle.catalog.series import select_specs

    return select_specs(_catalogue(spark, sf_dir), ASKED_CODES)


@query
def catalogue_entities(spark, sf_dir):
    return membership.distinct_members(_catalogue(spark, sf_dir), "entity")


def _coded_orders(spark, sf_dir) -> DataFrame:
    return nation_orders(spark, sf_dir).select(F.lower("entity").alias("code"), hundredths("o_totalprice").alias("amount"))


@query
def entity_enrichment(spark, sf_dir):
    dim = nations(spark, sf_dir).select("entity", "name", F.col("n_regionkey").alias("tier"), F.col("iso3").alias("currency"))
    rich = membership.enrich(_coded_orders(spark, sf_dir), dim, "code")
    return rich.groupBy("code", "name", "tier", "currency").agg(F.sum("amount").alias("amount"))


@query
def code_translation(spark, sf_dir):
    dim = nations(spark, sf_dir).select("entity", F.concat(F.lit("X"), F.col("n_nationkey")).alias("bis_code"))
    coded = membership.translate_code(_coded_orders(spark, sf_dir), dim, "code", "bis_code")
    return coded.groupBy("code", "provider_code").agg(F.count(F.lit(1)).alias("n_orders"))


@query
def store_round_trip(spark, sf_dir):
    """Three upserts into a fresh table, the last two as revisions, then a pruned read."""
    import uuid

    stored = ObservationTable(spark, f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}")
    orders = _revisions(spark, sf_dir)
    for status in ("F", "O", "P"):
        stored.upsert(orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus", "iso3"), "arrival")
    return stored.read(["order_size"], until=dt.date(1999, 12, 31)).select("entity", "date", "source", "value")


@query
def bucketed_snapshot(spark, sf_dir):
    """The customers' snapshot from a table bucketed by customer: no row is shuffled after the write."""
    import uuid

    name = f"panel_{uuid.uuid4().hex}"
    buckets = customer_buckets(spark, sf_dir)
    panel = monthly_panel(spark, sf_dir, "customer", partitions=buckets)
    stored = save_bucketed(panel, name, buckets, f"{ensure_checkpoint_dir(spark)}/{name}")
    snapshots = feature_snapshots(stored, [AS_OF], one_row_per_day=True, colocated=True)
    return snapshots.select("entity", "as_of", *[r6(n) for n in (*ALL_INDICATORS, *LAGGED_FEATURES)])


# ---- projections and scalar functions ---------------------------------------------------------

@query
def yoy_positional(spark, sf_dir):
    grown = series.year_over_year(landed_panel(spark, sf_dir), "M")
    return grown.select("entity", "indicator", "date", r6("value"))


@query
def yoy_calendar(spark, sf_dir):
    grown = series.year_over_year_calendar(landed_panel(spark, sf_dir))
    return grown.select("entity", "indicator", "date", r6("value"))


@query
def yoy_positional_sources(spark, sf_dir):
    """Three sources report the same days: each grows by itself."""
    grown = series.year_over_year(daily_panel(spark, sf_dir), "M")
    return grown.select("entity", "source", "date", r6("value"))


@query
def yoy_calendar_sources(spark, sf_dir):
    grown = series.year_over_year_calendar(daily_panel(spark, sf_dir))
    return grown.select("entity", "source", "date", r6("value"))


@query
def period_dates(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    year = F.date_format("d", "yyyy")
    forms = F.array(
        F.concat(year, F.lit("-Q"), F.quarter("d")), F.concat(year, F.lit("-M"), F.date_format("d", "MM")), year,
        F.date_format("d", "yyyy/MM"), F.concat(year, F.lit("-Q"), F.month("d")),
    )
    period = days.select(F.explode(forms).alias("period")).distinct()
    return period.select(
        "period", periods.period_start(F.col("period")).alias("first_day"),
        periods.period_end(F.col("period")).alias("last_day"),
        periods.period_error(F.col("period")).isNotNull().cast("int").alias("is_fault"),
    )


def _features(spark, sf_dir) -> DataFrame:
    panel = landed_panel(spark, sf_dir)
    return with_derived_features(feature_snapshots(panel, grid_dates(), nations(spark, sf_dir), one_row_per_day=True))


@query
def derived_features(spark, sf_dir):
    return _features(spark, sf_dir).select(
        "entity", "as_of", *[r6(n) for n in DERIVED_FEATURES], "st_data_date", "lt_data_date"
    )


@query
def growth_inflation_quadrants(spark, sf_dir):
    growth, cpi = F.col("real_gdp_yoy"), F.col("cpi_yoy")
    return _features(spark, sf_dir).select(
        "entity", "as_of", scalars.quadrant(growth, cpi).alias("quadrant"),
        scalars.quadrant(growth, cpi, 10.0, F.col("unemployment_rate")).alias("own_trend_quadrant"),
    )


@query
def caution_and_yield_regimes(spark, sf_dir):
    classified = _classified(spark, sf_dir)
    rate = F.col("real_rate_10y")
    return classified.select(
        "entity", "as_of", scalars.caution_level(F.col("lt_phase")).alias("caution"),
        scalars.real_yield_regime(rate).alias("regime"),
        F.round(scalars.real_yield_intensity(rate), 6).alias("intensity"),
    )


@query
def home_currency_overlay(spark, sf_dir):
    panel = landed_panel(spark, sf_dir)
    homes = home_real_rates(panel, grid_dates(), list(HOMES.values()), one_row_per_day=True)
    joined = _features(spark, sf_dir).join(homes.drop("_home"), "as_of", "left")
    intensity = scalars.home_currency_intensity(F.lit(HOME_CURRENCY), F.col("home_real_rate"), F.col("real_rate_10y"))
    return joined.select("entity", "as_of", r6("home_real_rate"), (F.round(intensity, 6) + 0.0).alias("intensity"))


@query
def threshold_delta_table(spark, sf_dir):
    deltas = threshold_deltas(calibrated_thresholds(landed_panel(spark, sf_dir), large_series_rows=None))
    return deltas.select("entity", "field", "default_value", r6("entity_value"), r6("delta"))


@query
def status_bands(spark, sf_dir):
    panel = landed_panel(spark, sf_dir)
    features = attach_signal(_features(spark, sf_dir), credit_signal(panel, grid=grid_dates(), enabled=SIGNAL_ENTITIES),
                             ["entity", "as_of"])
    return features.select(
        "entity", "as_of",
        scalars.status_band("total_debt", F.col("total_credit_pct_gdp")).alias("debt_band"),
        scalars.status_band("yield_curve", F.col("yield_curve_slope")).alias("curve_band"),
        scalars.status_band("real_rate", F.col("real_rate_10y")).alias("real_rate_band"),
        scalars.status_band("credit_spread_z", F.col("hy_spread_z")).alias("spread_band"),
    )


@query
def vote_reasons(spark, sf_dir):
    """The reasons of every vote, and the summary line."""
    views = _views(spark, sf_dir, "USD", with_reasons=True)
    return views.select(
        "entity", "as_of", "summary", F.transform("st_votes", lambda v: v["reason"]).cast("string").alias("st_reasons"),
        F.transform("lt_votes", lambda v: v["reason"]).cast("string").alias("lt_reasons"),
    )


# ---- as-of joins and snapshots -----------------------------------------------------------------

@query
def canonical_daily(spark, sf_dir):
    return canonical_panel(daily_panel(spark, sf_dir), PRIORITY).select("entity", "date", r6("value"))


@query
def repeated_natural_keys(spark, sf_dir):
    """Order lines read as observations of (brand, day, flag): which keys collide."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"))
    rows = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "entity", F.lit("quantity").alias("indicator"), F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("source"),
    )
    return duplicate_keys(rows)


@query
def asof_latest(spark, sf_dir):
    found = latest_at(daily_panel(spark, sf_dir), AS_OF, PRIORITY)
    return found.select("entity", "indicator", r6("value"), "observed_on")


@query
def asof_over_grid(spark, sf_dir):
    """Multi-source daily series on a month-end grid whose days drift, without lags."""
    grid = date_grid(dt.date(1995, 1, 31), dt.date(2001, 12, 31), "M")
    found = asof_grid(daily_panel(spark, sf_dir), grid, priority=PRIORITY)
    return found.select("entity", "as_of", r6("value"), "observed_on")


@query
def asof_probe_join(spark, sf_dir):
    """Every order looks up every indicator of its nation on its order day."""
    probes = nation_orders(spark, sf_dir).select(
        "o_orderkey", "entity", F.to_date("o_orderdate").alias("as_of"), F.explode(F.array(*map(F.lit, INDICATORS))).alias("indicator"),
    )
    return asof_join(probes, landed_panel(spark, sf_dir)).select("o_orderkey", "indicator", "as_of", r6("value"), "observed_on")


# ---- as-of by date and load time

LOG_INDICATORS = (
    "real_gdp_yoy", "cpi_yoy", "unemployment_rate", "policy_rate", "yield_10y", "yield_2y", "total_credit_pct_gdp", "debt_service_ratio",
)


def order_log(spark, sf_dir) -> DataFrame:
    """Orders as a log of revisions of (nation, indicator, month), each loaded up to 199 days after its order."""
    h, which = hundredths("o_totalprice"), F.col("o_orderkey") % len(LOG_INDICATORS)

    def share(modulus: int) -> Column:
        return (h % modulus).cast("double") / F.lit(100.0)

    value = F.when(which == 6, F.lit(100.0) + share(25000)).when(which == 7, F.lit(10.0) + share(1500)).otherwise(share(1000) - F.lit(3.0))
    return nation_orders(spark, sf_dir).select(
        "entity", F.element_at(F.array(*map(F.lit, LOG_INDICATORS)), which.cast("int") + 1).alias("indicator"),
        F.to_date(F.trunc("o_orderdate", "MM")).alias("date"), value.alias("value"), F.lit("ORD").alias("source"), F.lit("S").alias("series_id"),
        (F.col("o_orderdate") + F.make_dt_interval((F.col("o_custkey") % 200).cast("int"))).alias("fetched_at"),
        F.col("o_orderkey").alias("arrival"),
    )


@query
def asof_by_vintage(spark, sf_dir):
    """Every quarter sees the newest month it knew, and its lags, at the values it knew."""
    found = asof_vintages(order_log(spark, sf_dir), grid_dates(), grid_dates(), lags=[90, 1825])
    return found.select("entity", "indicator", "as_of", r6("value"), "observed_on", r6("lag_90d"), r6("lag_1825d"))


@query
def regime_replay_vintages(spark, sf_dir):
    """Both classifiers on every quarter, over the values and thresholds known then."""
    replayed = replay(
        order_log(spark, sf_dir), REPLAY_START, REPLAY_END, entities=nations(spark, sf_dir).select("entity"), calibration="expanding",
        signal_asof="none", known_by="as_of",
    )
    return _rounded_path(replayed)


@query
def trailing_zscores_vintages(spark, sf_dir):
    """Scores of every series of the log over two years of the values known at each date."""
    scored = trailing_zscore_grid(order_log(spark, sf_dir), grid_dates(), window_days=730, min_observations=3, known_by=grid_dates())
    return scored.select("entity", "indicator", "as_of", "n_obs", r6("latest"), r6("z"))


# ---- as-of on timestamps

EVENT_COLUMNS = PanelColumns(date="ts")


def event_panel(spark, sf_dir) -> DataFrame:
    """Events as series by type; a third of the users report to one series of their own."""
    hot = F.col("user_id") % 3 == 0
    return table(spark, sf_dir, "events").select(
        F.when(hot, "HOT").otherwise(F.col("event_type")).alias("entity"), F.lit("value").alias("indicator"), "ts", "value", "event_id",
    )


@query
def asof_hourly(spark, sf_dir):
    """The newest event of every series at every full hour of the month."""
    grid = hourly_grid(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31))
    found = asof_time_grid(event_panel(spark, sf_dir), grid, ["event_id"], EVENT_COLUMNS)
    return found.select("entity", "as_of", r6("value"), "observed_at")


@query
def asof_event_probes(spark, sf_dir):
    """Every event looks up the hot series at its own time."""
    events = event_panel(spark, sf_dir)
    probes = events.where("entity <> 'HOT'").select(F.lit("HOT").alias("entity"), "indicator", F.col("ts").alias("as_of"), "event_id")
    found = asof_time_join(probes, events, block=dt.timedelta(hours=2), ties=["event_id"], cols=EVENT_COLUMNS)
    return found.select("event_id", "as_of", r6("value"), "observed_at")


@query
def event_time_lags(spark, sf_dir):
    """Every event with its series' value half an hour and six hours before."""
    lags = {"lag_30m": dt.timedelta(minutes=30), "lag_6h": dt.timedelta(hours=6)}
    lagged = with_time_lags(event_panel(spark, sf_dir), lags, ties=["event_id"], cols=EVENT_COLUMNS)
    return lagged.select("event_id", "entity", r6("value"), r6("lag_30m"), r6("lag_6h"))


# ---- entities of three columns

KEYED = PanelColumns(entity=("nation", "brand", "flag"))


def keyed_panel(spark, sf_dir) -> DataFrame:
    """Nation x brand x return flag by month, all of lineitem."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    orders = nation_orders(spark, sf_dir).select("o_orderkey", F.col("entity").alias("nation"), F.to_date(F.trunc("o_orderdate", "MM")).alias("date"))
    n = F.count(F.lit(1)).cast("double")
    monthly = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("nation", "brand", F.col("l_returnflag").alias("flag"), "date").agg(
        (F.sum(hundredths("l_discount")).cast("double") / n).alias("cpi_yoy"), (F.sum(hundredths("l_tax")).cast("double") / n).alias("policy_rate"),
        (F.sum(hundredths("l_quantity")).cast("double") / n).alias("total_credit_pct_gdp"),
    )
    long = monthly.unpivot(["nation", "brand", "flag", "date"], ["cpi_yoy", "policy_rate", "total_credit_pct_gdp"], "indicator", "value")
    return long.withColumns({"source": F.lit("STAR"), "series_id": F.lit("K")})


@query
def keyed_snapshot(spark, sf_dir):
    """As-of values and lags of entities that are three columns."""
    names = ("cpi_yoy", "policy_rate", "total_credit_pct_gdp")
    found = feature_snapshots(keyed_panel(spark, sf_dir), [AS_OF, TODAY], indicators=names, cols=KEYED)
    lags = [f for f, (i, _) in LAGGED_FEATURES.items() if i in names]
    return found.select(*KEYED.entity_key, "as_of", *[r6(c) for c in (*names, *lags)], "cpi_yoy_date")


@query
def keyed_latest(spark, sf_dir):
    found = latest_at(keyed_panel(spark, sf_dir), AS_OF, cols=KEYED)
    return found.select(*KEYED.series_key, r6("value"), "observed_on")


@query
def keyed_probe_join(spark, sf_dir):
    """Every order line asks for its own nation, brand and flag on its ship day."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    orders = nation_orders(spark, sf_dir).select("o_orderkey", F.col("entity").alias("nation"))
    lines = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "nation", "brand", F.col("l_returnflag").alias("flag"), F.lit("policy_rate").alias("indicator"),
        F.to_date("l_shipdate").alias("as_of"),
    )
    found = asof_join(asked, keyed_panel(spark, sf_dir), cols=KEYED)
    return found.select("l_orderkey", "l_linenumber", *KEYED.entity_key, "as_of", r6("value"), "observed_on")


@query
def keyed_lags(spark, sf_dir):
    lagged = with_anchor_lags(canonical_panel(keyed_panel(spark, sf_dir), cols=KEYED), [90, 365], KEYED)
    return lagged.select(*KEYED.series_key, "date", r6("value"), r6("lag_90d"), r6("lag_365d"))


@query
def keyed_quantiles(spark, sf_dir):
    found = series_quantiles(keyed_panel(spark, sf_dir), CALIBRATION_QUANTILES, 5, cols=KEYED)
    return found.select(*KEYED.series_key, "n_obs", *[r6(f"q{q}") for q in (50, 75, 90, 95)])


@query
def anchor_lags(spark, sf_dir):
    daily = canonical_panel(daily_panel(spark, sf_dir), PRIORITY)
    lagged = with_anchor_lags(daily, [90, 180, 1825])
    return lagged.select("entity", "date", r6("value"), r6("lag_90d"), r6("lag_180d"), r6("lag_1825d"))


@query
def feature_snapshot(spark, sf_dir):
    snapshots = feature_snapshots(landed_panel(spark, sf_dir), grid_dates(), nations(spark, sf_dir), one_row_per_day=True)
    values = [r6(n) for n in (*ALL_INDICATORS, *LAGGED_FEATURES)]
    return snapshots.select("entity", "as_of", *values, *[f"{n}_date" for n in ALL_INDICATORS])


@query
def feature_snapshot_customers(spark, sf_dir):
    """The same snapshot keyed by customer: as many entities as customers with orders."""
    panel = landed_panel(spark, sf_dir, "customer")
    snapshots = feature_snapshots(panel, [AS_OF], one_row_per_day=True, colocated=True)
    return snapshots.select("entity", "as_of", *[r6(n) for n in (*ALL_INDICATORS, *LAGGED_FEATURES)])


@query
def home_rates(spark, sf_dir):
    panel = landed_panel(spark, sf_dir)
    rates = home_real_rates(panel, grid_dates(), ["NATION_5", "NATION_8", "NOWHERE"], one_row_per_day=True)
    return rates.select(F.col("_home").alias("home"), "as_of", r6("home_real_rate"))


def _as_euro_bloc(rows: DataFrame) -> DataFrame:
    """Nation 4 plays the bloc."""
    return rows.withColumn("iso3", F.when(F.col("iso3") == "N4", "EMU").otherwise(F.col("iso3")))


@query
def bloc_expansion(spark, sf_dir):
    views = _classified(spark, sf_dir).join(nations(spark, sf_dir).select("entity", "iso3"), "entity")
    return membership.expand_blocs(_as_euro_bloc(views)).select("map_iso3", "entity", "as_of", "lt_phase")


@query
def member_to_bloc(spark, sf_dir):
    expanded = membership.expand_blocs(_as_euro_bloc(nations(spark, sf_dir)))
    known = {"N1": "US", "N2": "CN"}
    from panelcycle.catalog.entities import iso3_to_entity

    entity = membership.member_to_entity(F.col("map_iso3"), {**iso3_to_entity(), **known})
    return expanded.select("map_iso3", entity.alias("basket_entity"))


# ---- aggregations and calibration ----------------------------------------------------------------

@query
def series_quantile_table(spark, sf_dir):
    found = series_quantiles(landed_panel(spark, sf_dir), CALIBRATION_QUANTILES, MIN_OBSERVATIONS, large_series_rows=None)
    return found.select("entity", "indicator", "n_obs", *[r6(f"q{q}") for q in (50, 75, 90, 95)])


@query
def series_quantiles_large(spark, sf_dir):
    """Three series share all of lineitem; every one is cut into value bins."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("entity"), F.lit("price").alias("indicator"), F.col("l_extendedprice").alias("value")
    )
    found = series_quantiles(rows, CALIBRATION_QUANTILES, MIN_OBSERVATIONS, large_series_rows=1_000)
    return found.select("entity", "indicator", "n_obs", *[r6(f"q{q}") for q in (50, 75, 90, 95)])


@query
def entity_thresholds(spark, sf_dir):
    found = calibrated_thresholds(landed_panel(spark, sf_dir), large_series_rows=None)
    return found.select("entity", *[r6(n) for n in DEFAULT_THRESHOLDS])


@query
def expanding_quantile_table(spark, sf_dir):
    """Monthly grid over daily series of three sources; the sources' rows all count."""
    grid = date_grid(dt.date(1995, 3, 1), dt.date(2001, 12, 1), "M")
    found = expanding_quantiles(daily_panel(spark, sf_dir), grid, CALIBRATION_QUANTILES, MIN_OBSERVATIONS)
    return found.select("entity", "as_of", "n_obs", *[r6(f"q{q}") for q in (50, 75, 90, 95)])


@query
def expanding_entity_thresholds(spark, sf_dir):
    found = expanding_thresholds(landed_panel(spark, sf_dir), grid_dates(), large_series_rows=None)
    return found.select("entity", "as_of", *[r6(n) for n in DEFAULT_THRESHOLDS])


@query
def threshold_fallback(spark, sf_dir):
    """Customers mostly lack 40 months, so fields fall back one by one."""
    panel = landed_panel(spark, sf_dir, "customer")
    own = calibrated_thresholds(panel, min_observations=10, large_series_rows=None)
    everyone = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity"))
    return with_thresholds(everyone, own).select("entity", *[r6(n) for n in DEFAULT_THRESHOLDS])


@query
def trailing_zscores(spark, sf_dir):
    """Daily multi-source series against their last two years."""
    scored = trailing_zscore(daily_panel(spark, sf_dir), TODAY, window_days=730, priority=PRIORITY)
    return scored.select("entity", "n_obs", r6("latest"), r6("z"))


@query
def trailing_zscores_on_grid(spark, sf_dir):
    grid = date_grid(dt.date(1997, 1, 1), dt.date(2001, 7, 1), "Q")
    scored = trailing_zscore_grid(daily_panel(spark, sf_dir), grid, window_days=365, priority=PRIORITY)
    return scored.select("entity", "as_of", "n_obs", r6("latest"), r6("z"))


@query
def gated_credit_signal(spark, sf_dir):
    panel = landed_panel(spark, sf_dir)
    signal = credit_signal(panel, TODAY, enabled=SIGNAL_ENTITIES)
    joined = attach_signal(nations(spark, sf_dir).select("entity"), signal, ["entity"])
    return joined.select("entity", r6("hy_spread"), r6("hy_spread_z"))


@query
def series_summaries(spark, sf_dir):
    return series.series_summary(landed_panel(spark, sf_dir))


@query
def series_changes(spark, sf_dir):
    changes = series.series_change(landed_panel(spark, sf_dir))
    return changes.select(
        "entity", "indicator", "first_date", "last_date", r6("first_value"), r6("last_value"), r6("change"),
        "last_year", "last_quarter",
    )


@query
def series_tails(spark, sf_dir):
    return series.tail_rows(canonical_panel(daily_panel(spark, sf_dir), PRIORITY), 60).select("entity", "date", r6("value"))


@query
def series_changes_sources(spark, sf_dir):
    """First and last value where three sources report one day."""
    changes = series.series_change(daily_panel(spark, sf_dir), priority=PRIORITY)
    return changes.select("entity", "first_date", "last_date", r6("first_value"), r6("last_value"), r6("change"))


@query
def series_tails_sources(spark, sf_dir):
    """The newest 25 rows, sources of one day in priority order."""
    rows = series.tail_rows(daily_panel(spark, sf_dir), 25, priority=PRIORITY)
    return rows.select("entity", "date", "source", r6("value"))


@query
def display_tails(spark, sf_dir):
    tails = {**series.DISPLAY_TAILS, "real_gdp_yoy": 24, "debt_service_ratio": 36}
    return series.display_tails(landed_panel(spark, sf_dir), tails).select("entity", "indicator", "date", r6("value"))


# ---- rules, votes, decisions -----------------------------------------------------------------------

def _rule_features(spark, sf_dir) -> DataFrame:
    panel = landed_panel(spark, sf_dir)
    signal = credit_signal(panel, grid=grid_dates(), enabled=SIGNAL_ENTITIES)
    features = attach_signal(_features(spark, sf_dir), signal, ["entity", "as_of"])
    return with_thresholds(features, calibrated_thresholds(panel, large_series_rows=None))


@query
def short_term_votes(spark, sf_dir):
    voted = cast_votes(_rule_features(spark, sf_dir), SHORT_TERM_RULES, "st", with_reasons=False, keep_rules=True)
    return long_votes(voted, SHORT_TERM_RULES, "st", ["entity", "as_of"]).drop("position")


@query
def long_term_votes(spark, sf_dir):
    voted = cast_votes(_rule_features(spark, sf_dir), LONG_TERM_RULES, "lt", with_reasons=False, keep_rules=True)
    return long_votes(voted, LONG_TERM_RULES, "lt", ["entity", "as_of"]).drop("position")


@query
def class_weights(spark, sf_dir):
    voted = cast_votes(_rule_features(spark, sf_dir), SHORT_TERM_RULES, "st", with_reasons=False)
    voted = cast_votes(voted, LONG_TERM_RULES, "lt", with_reasons=False)
    weights = [r6(f"st_w{k}") for k in (1, 2, 3, 4)] + [r6(f"lt_w{k}") for k in (1, 2, 3, 4, 5, 6)]
    return voted.select("entity", "as_of", *weights, "st_n_votes", "lt_n_votes")


def _classified(spark, sf_dir, **options) -> DataFrame:
    options = {"signal_entities": SIGNAL_ENTITIES, "one_row_per_day": True, "with_reasons": False, **options}
    return classify(landed_panel(spark, sf_dir), grid_dates(), TODAY, nations(spark, sf_dir).select("entity"), **options)


@query
def short_term_stage(spark, sf_dir):
    """Stage of each nation on one day under the default thresholds."""
    options = {"thresholds": None, "signal_asof": "none", "one_row_per_day": True, "with_reasons": False}
    found = classify(landed_panel(spark, sf_dir), [AS_OF], entities=nations(spark, sf_dir).select("entity"), **options)
    return found.select("entity", "as_of", "st_stage", "st_label", r6("st_confidence"), "st_n_votes")


@query
def regime_replay(spark, sf_dir):
    """Both classifiers on every quarter, today's signal on every date."""
    replayed = replay(
        landed_panel(spark, sf_dir), REPLAY_START, REPLAY_END, "Q", TODAY, nations(spark, sf_dir).select("entity"),
        signal_entities=SIGNAL_ENTITIES, one_row_per_day=True,
    )
    return _rounded_path(replayed)


@query
def regime_replay_point_in_time(spark, sf_dir):
    """Thresholds and signal of each date, and rows seen 45 days after their period starts."""
    replayed = replay(
        landed_panel(spark, sf_dir), REPLAY_START, REPLAY_END, "Q", TODAY, nations(spark, sf_dir).select("entity"),
        calibration="expanding", signal_asof="as_of", publication_lag_days=45, signal_entities=SIGNAL_ENTITIES, one_row_per_day=True,
    )
    return _rounded_path(replayed)


@query
def regime_replay_customers(spark, sf_dir):
    """Every customer on every quarter, without the signal."""
    replayed = replay(
        landed_panel(spark, sf_dir, "customer"), REPLAY_START, REPLAY_END, "Q", TODAY,
        signal_asof="none", one_row_per_day=True, colocated=True,
    )
    return _rounded_path(replayed)


def _rounded_path(replayed: DataFrame) -> DataFrame:
    return replayed.select(
        "entity", "date", "st_stage", "st_label", r6("st_confidence"), "lt_phase", "lt_label", r6("lt_confidence")
    )


def _sourced(spark, sf_dir) -> dict:
    """Arguments for plans over the panel of three sources; all others stay at their defaults."""
    return {"today": TODAY, "entities": nations(spark, sf_dir).select("entity"), "signal_entities": SIGNAL_ENTITIES,
            "priority": SOURCE_PRIORITY}


@query
def feature_snapshot_sources(spark, sf_dir):
    """As-of values and lags where up to two sources report a day and a third one reports between them."""
    found = feature_snapshots(sourced_panel(spark, sf_dir), grid_dates(), nations(spark, sf_dir), priority=SOURCE_PRIORITY)
    return found.select("entity", "as_of", *[r6(c) for c in (*ALL_INDICATORS, *LAGGED_FEATURES)])


@query
def regime_replay_sources(spark, sf_dir):
    """The replay with its default plan over a panel of three sources."""
    return _rounded_path(replay(sourced_panel(spark, sf_dir), REPLAY_START, REPLAY_END, **_sourced(spark, sf_dir)))


@query
def regime_replay_sources_point_in_time(spark, sf_dir):
    """Thresholds and signal of each date, default plan, three sources."""
    replayed = replay(sourced_panel(spark, sf_dir), REPLAY_START, REPLAY_END, calibration="expanding", signal_asof="as_of",
                      **_sourced(spark, sf_dir))
    return _rounded_path(replayed)


@query
def entity_view_headers_sources(spark, sf_dir):
    views = entity_views(sourced_panel(spark, sf_dir), grid_dates(), HOME_CURRENCY, HOMES, **_sourced(spark, sf_dir))
    return views.select("entity", "as_of", "st_label", "lt_label", r6("st_confidence"), r6("lt_confidence"), "caution_level", "real_yield_regime")


USER_RULES = RuleSet(
    (
        Rule("inverted", 2, case(("yield_curve_slope < 0D", 0.6)), text("curve at %.2fpp", "yield_curve_slope")),
        Rule("hot", 2, case(("cpi_yoy > cpi_elevated", 0.5)), text("inflation %.2f%%", "cpi_yoy")),
        Rule("cheap_money", 1, case(("real_rate_10y < -2D", 0.9), ("real_rate_10y < 0D", 0.4)), text("real rate %+.1f%%", "real_rate_10y")),
    ),
    {0: "Unclear", 1: "Loose", 2: "Tight"},
)


@query
def regime_replay_user_rules(spark, sf_dir):
    """The replay under a user's own short cycle of two classes."""
    replayed = replay(
        landed_panel(spark, sf_dir), REPLAY_START, REPLAY_END, "Q", TODAY, nations(spark, sf_dir).select("entity"),
        signal_entities=SIGNAL_ENTITIES, short_term=USER_RULES,
    )
    return replayed.select("entity", "date", "st_stage", "st_label", r6("st_confidence"), "lt_phase")


@query
def phase_path_gate(spark, sf_dir):
    replayed = _classified(spark, sf_dir).select("entity", "lt_phase")
    return entities_with_a_path(replayed)


# ---- tilts and views ----------------------------------------------------------------------------------

def _views(spark, sf_dir, currency: str, with_reasons: bool = False) -> DataFrame:
    return entity_views(
        landed_panel(spark, sf_dir), grid_dates(), currency, HOMES, today=TODAY,
        entities=nations(spark, sf_dir).select("entity"), signal_entities=SIGNAL_ENTITIES, one_row_per_day=True,
        with_reasons=with_reasons,
    )


@query
def asset_tilt_table(spark, sf_dir):
    """All four layers, seen from a foreign home currency."""
    long = explode_tilts(_views(spark, sf_dir, HOME_CURRENCY), ["entity", "as_of"])
    return long.select("entity", "as_of", "asset", r6("tilt"))


@query
def asset_tilt_table_usd(spark, sf_dir):
    long = explode_tilts(asset_tilts(_classified(spark, sf_dir), with_reasons=False), ["entity", "as_of"])
    return long.select("entity", "as_of", "asset", r6("tilt"), "direction")


@query
def top_tilt_table(spark, sf_dir):
    best = top_tilts(asset_tilts(_classified(spark, sf_dir), with_reasons=False), ["entity", "as_of"], 3)
    return best.select("entity", "as_of", "rank", "asset", r6("tilt"))


@query
def ranked_tilts(spark, sf_dir):
    """All eight assets ranked by a window over the long table."""
    long = explode_tilts(asset_tilts(_classified(spark, sf_dir), with_reasons=False), ["entity", "as_of"])
    return rank_long_tilts(long, ["entity", "as_of"], 8).select("entity", "as_of", "rank", "asset", r6("tilt"))


VIEWER_HOMES = {"SEK": "NATION_5", "EUR": "NATION_8"}


@query
def viewer_tilt_table(spark, sf_dir):
    """Every entity seen from five currencies in one job; two have a home in the panel."""
    views = viewer_views(
        landed_panel(spark, sf_dir), grid_dates(), ["SEK", "EUR", "USD", "INR", "BRL"], VIEWER_HOMES, today=TODAY,
        entities=nations(spark, sf_dir).select("entity"), signal_entities=SIGNAL_ENTITIES, one_row_per_day=True, with_reasons=False,
    )
    return explode_tilts(views, ["entity", "as_of", "home_currency"]).select("entity", "as_of", "home_currency", "asset", r6("tilt"))


@query
def tilt_reasons(spark, sf_dir):
    """What moves each tilt by more than a hundredth, in words."""
    long = explode_tilts(_views(spark, sf_dir, HOME_CURRENCY, with_reasons=True), ["entity", "as_of"])
    return long.select("entity", "as_of", "asset", "reasons")


@query
def entity_view_headers(spark, sf_dir):
    views = _views(spark, sf_dir, HOME_CURRENCY)
    return views.select(
        "entity", "as_of", "st_stage", "st_label", r6("st_confidence"), "lt_phase", "lt_label", r6("lt_confidence"),
        "caution_level", "real_yield_regime", "home_currency",
    )


@query
def world_basket(spark, sf_dir):
    """Nations and regions as one basket; regions have no series of their own."""
    basket = nations(spark, sf_dir).select("entity", "iso3", "name").unionByName(
        table(spark, sf_dir, "region").select(
            F.col("r_name").alias("entity"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("iso3"),
            F.concat(F.lit("Region "), F.col("r_regionkey")).alias("name"),
        )
    )
    view = world_view(landed_panel(spark, sf_dir), basket, AS_OF, today=TODAY, signal_entities=SIGNAL_ENTITIES,
                      one_row_per_day=True)
    return view.select(
        "entity", "iso3", "name", F.col("has_data").cast("int").alias("has_data"), "lt_phase", "lt_label",
        "st_stage", "st_label", "caution_level", r6("total_debt_pct_gdp"), r6("debt_service_ratio"),
        r6("cpi_yoy"), r6("real_rate_10y"),
    )


@query
def panel_landing(spark, sf_dir):
    """The monthly panel itself, straight from the star schema."""
    return monthly_panel(spark, sf_dir).select("entity", "indicator", "date", r6("value"), "source")
