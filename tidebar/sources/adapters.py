"""The synthetic tables as market data.

events -> ticks: the 24 hours of a day are mapped onto the 240 session minutes. lineitem -> daily bars. supplier -> instruments and
universe. orders -> strategy signals. Prices are whole hundredths (ticks) from the source on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.session import clock


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str, symbols: int = 20) -> DataFrame:
    """symbol, trading_date, event_time, minute, price_ticks, volume, event_id, worker_id."""
    e = table(spark, folder, "events").filter("value > 0")
    return tick_rows(e, symbols)


def tick_rows(events: DataFrame, symbols: int = 20) -> DataFrame:
    minute = F.floor((F.hour("ts") * 60 + F.minute("ts")) / 6).cast("int")
    date = F.to_date("ts")
    return events.select(
        F.concat(F.lit("U"), (F.col("user_id") % symbols).cast("string")).alias("symbol"),
        date.alias("trading_date"),
        F.timestamp_add("SECOND", F.second("ts").cast("int"), clock(date, minute)).alias("event_time"),
        minute.alias("minute"),
        F.round(F.col("value") * 100).cast("long").alias("price_ticks"),
        F.get_json_object("props", "$.k").cast("long").alias("volume"),
        "event_id",
        F.col("user_id").alias("worker_id"),
    )


def from_wire(rows: DataFrame) -> DataFrame:
    """Ticks as they are sent: prices in millionths become whole hundredths, a bid or ask of zero is none."""
    ticks = lambda c: F.round(F.col(c) / 10_000).cast("long")
    sides = {f"{s}_ticks": F.when(F.col(f"{s}_e6") > 0, ticks(f"{s}_e6")) for s in ("bid", "ask", "pre_close")}
    return rows.withColumns({"price_ticks": ticks("price_e6")} | sides).drop("price_e6", "bid_e6", "ask_e6", "pre_close_e6")


def daily_bars(spark: SparkSession, folder: str, symbols: int = 10) -> DataFrame:
    """Daily bars from order lines; open and close by order, line and, since these can repeat, part, price and quantity."""
    li = table(spark, folder, "lineitem")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", price.alias("p"), "l_quantity")
    return (
        li.groupBy(F.concat(F.lit("S"), (F.col("l_suppkey") % symbols).cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("trading_date"))
        .agg(
            F.min_by(price, order).alias("open_ticks"), F.max(price).alias("high_ticks"), F.min(price).alias("low_ticks"), F.max_by(price, order).alias("close_ticks"),
            F.sum("l_quantity").cast("long").alias("volume"), F.sum(price).alias("amount_ticks"),
        )
    )


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    return s.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), F.col("s_name").alias("name"), (F.col("s_acctbal") >= 0).alias("is_eligible"),
        "s_suppkey", F.col("s_nationkey").alias("nation"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: symbol, strategy_code, trading_date, observed_at, score (60 to 99), status, signal_id."""
    o = table(spark, folder, "orders")
    at = F.timestamp_add("SECOND", (F.col("o_orderkey") % 14400).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    status = F.when(F.col("o_orderstatus") == "F", "expired").when(F.col("o_orderstatus") == "P", "weakened").otherwise("active")
    return o.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("symbol"), F.col("o_orderpriority").alias("strategy_code"), F.to_date("o_orderdate").alias("trading_date"),
        at.alias("observed_at"), (F.lit(60) + F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(40))).cast("int").alias("score"), status.alias("status"),
        F.col("o_orderkey").alias("signal_id"),
    )
