"""Panels over the star schema: what plays the part of which indicator.

All amounts have two decimals, so they are summed as whole hundredths and divided once. The
results are the same to the last bit on any engine and in any order of addition.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcycle.operators.series import percent_change
from panelcycle.session import ensure_checkpoint_dir, materialize
from panelcycle.sources.tables import save_bucketed

AS_OF = dt.date(2000, 6, 30)
TODAY = dt.date(2001, 9, 1)
REPLAY_START, REPLAY_END = dt.date(1995, 10, 1), dt.date(2001, 8, 1)
SIGNAL_ENTITIES = ("NATION_3", "NATION_7", "NATION_11", "NATION_19")
HOME_CURRENCY, HOMES = "SEK", {"SEK": "NATION_5"}

INDICATORS = (
    "real_gdp_yoy", "cpi_yoy", "unemployment_rate", "policy_rate", "yield_10y", "yield_2y",
    "total_credit_pct_gdp", "gov_debt_pct_gdp", "private_nonfin_pct_gdp", "hh_debt_pct_gdp",
    "corp_debt_pct_gdp", "debt_service_ratio", "hy_spread",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(column: str) -> Column:
    """Whole hundredths of a two-decimal amount; rint stays in primitive doubles, round does not."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _order_keys(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """orderkey, entity, order total and month. Only nations are small by nature; the customer
    join is left to Catalyst, which broadcasts under its size limit and splits skewed keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    if by == "customer":
        keyed = orders.withColumn("entity", F.col("o_custkey").cast("string"))
    else:
        nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        homes = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        keyed = orders.join(homes, F.col("o_custkey") == F.col("c_custkey"))
    return keyed.select(
        "o_orderkey", "entity", hundredths("o_totalprice").alias("order_total"),
        F.to_date(F.trunc("o_orderdate", "MM")).alias("date"),
    )


def monthly_wide(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """Entity x month sums; partial sums are formed before the shuffle on (entity, month)."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus",
        hundredths("l_extendedprice").alias("price"), hundredths("l_discount").alias("discount"),
        hundredths("l_tax").alias("tax"), hundredths("l_quantity").alias("quantity"),
    )
    joined = lines.join(_order_keys(spark, sf_dir, by), F.col("l_orderkey") == F.col("o_orderkey"))
    returned, added, open_ = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"

    def total(value: str, condition: Column | None = None) -> Column:
        return F.sum(F.col(value) if condition is None else F.when(condition, F.col(value))).cast("double")

    return joined.groupBy("entity", "date").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.count_if(returned).cast("double").alias("n_r"),
        F.count_if(added).cast("double").alias("n_a"),
        F.count_if(open_).cast("double").alias("n_o"),
        total("price").alias("price"), total("discount").alias("discount"),
        total("quantity").alias("quantity"), total("order_total").alias("order_total"),
        total("tax").alias("tax"), total("tax", open_).alias("tax_o"),
        total("tax", returned).alias("tax_r"), total("tax", added).alias("tax_a"),
    )


def monthly_panel(spark: SparkSession, sf_dir: str, by: str = "nation", source: str = "STAR", partitions: int | None = None) -> DataFrame:
    """Long panel (entity, indicator, date, value, source, series_id), dealt by entity to ``partitions`` if given."""
    wide = monthly_wide(spark, sf_dir, by)
    if partitions is not None:
        wide = wide.repartition(partitions, "entity")
    c = F.col

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.when(bottom != 0, bottom)

    in_order = Window.partitionBy("entity").orderBy("date")
    roles = {
        "real_gdp_yoy": percent_change(c("price"), F.lag("price", 12).over(in_order)),
        "cpi_yoy": F.lit(3.0) + F.lit(2.0) * (c("discount") / c("n") - F.lit(5.0)),
        "unemployment_rate": c("tax") / c("n"),
        "policy_rate": ratio(c("tax_o"), c("n_o")),
        "yield_10y": c("quantity") / c("n") / F.lit(600.0),
        "yield_2y": ratio(c("tax_r"), c("n_r")),
        "total_credit_pct_gdp": F.lit(1000.0) * c("price") / c("order_total"),
        "gov_debt_pct_gdp": F.lit(100.0) * c("n_o") / c("n"),
        "private_nonfin_pct_gdp": F.lit(100.0) * (c("n_r") + c("n_a")) / c("n"),
        "hh_debt_pct_gdp": F.lit(100.0) * c("n_r") / c("n"),
        "corp_debt_pct_gdp": F.lit(100.0) * c("n_a") / c("n"),
        "debt_service_ratio": F.lit(50.0) * c("n_r") / c("n"),
        "hy_spread": F.when(c("entity").isin(list(SIGNAL_ENTITIES)), ratio(c("tax_a"), c("n_a"))),
    }
    # an array of rows and not unpivot, which forgets how its input is partitioned
    pairs = F.array(*[F.struct(F.lit(n).alias("indicator"), c(n).alias("value")) for n in roles])
    named = wide.select("entity", "date", *[e.alias(n) for n, e in roles.items()])
    rows = named.select("entity", "date", F.inline_outer(pairs))
    return rows.where(F.col("value").isNotNull()).select(
        "entity", "indicator", "date", "value", F.lit(source).alias("source"),
        F.concat_ws(".", "indicator", "entity").alias("series_id"),
    )


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brand x ship day, three sources (return flags) per day, over all of lineitem."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(
        F.col("p_brand").alias("entity"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("source")
    ).agg(
        (F.sum(hundredths("l_quantity")).cast("double") / F.count(F.lit(1)).cast("double")).alias("value")
    ).select(
        "entity", F.lit("quantity").alias("indicator"), "date", "value", "source",
        F.concat_ws(".", F.lit("quantity"), "source").alias("series_id"),
    )


def sourced_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations' panel from three sources: ALT repeats the days of every second month with other
    values, MID reports the middle of every third month. Landed once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "sources")
    if key not in _LANDED:
        value, month = F.col("value"), F.year("date") * 12 + F.month("date")

        def report(source: str, date: Column, amount: Column) -> Column:
            return F.struct(F.lit(source).alias("source"), date.alias("date"), amount.alias("value"))

        reports = F.array(
            report("STAR", F.col("date"), value),
            report("ALT", F.col("date"), F.when(month % 2 == 0, value * 1.25)),
            report("MID", F.date_add("date", 14), F.when(month % 3 == 0, value * 0.75)),
        )
        rows = landed_panel(spark, sf_dir).select("entity", "indicator", "series_id", F.inline(reports))
        _LANDED[key] = materialize(rows.where(F.col("value").isNotNull()), "panel-sources", ["indicator"])
    return _LANDED[key]


def grid_dates() -> list[dt.date]:
    from panelcycle.plans.replay import date_grid

    return date_grid(REPLAY_START, REPLAY_END, "Q")


_LANDED: dict[tuple[str, str, str], DataFrame] = {}


# An order is about ten observations of its customer; a bucket is what one task works on.
ORDERS_PER_BUCKET = 25_000


def customer_buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets for the customers' panel: as many as the orders ask for, so that none grows with the table."""
    orders = table(spark, sf_dir, "orders").count()
    return max(spark.sparkContext.defaultParallelism, -(-orders // ORDERS_PER_BUCKET))


def landed_panel(spark: SparkSession, sf_dir: str, by: str = "nation") -> DataFrame:
    """The monthly panel, landed once per session: the nations' as a table partitioned by indicator, the
    customers' as one bucketed by entity, for readers that pass ``colocated=True``."""
    key = (spark.sparkContext.applicationId, sf_dir, by)
    if key not in _LANDED:
        if by == "customer":
            name, buckets = f"panel_customer_{uuid.uuid4().hex}", customer_buckets(spark, sf_dir)
            panel = monthly_panel(spark, sf_dir, by, partitions=buckets)
            _LANDED[key] = save_bucketed(panel, name, buckets, f"{ensure_checkpoint_dir(spark)}/{name}")
        else:
            _LANDED[key] = materialize(monthly_panel(spark, sf_dir, by), f"panel-{by}", ["indicator"])
    return _LANDED[key]
