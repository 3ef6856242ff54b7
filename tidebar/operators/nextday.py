"""Validation of events on the next trading day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 48


def next_trading_date(dates: DataFrame) -> DataFrame:
    """Each trading date with the one after it."""
    return dates.select("trading_date").distinct().withColumn("next_date", F.lead("trading_date").over(Window.orderBy("trading_date")))


def validate(events: DataFrame, bars5: DataFrame, calendar: DataFrame, as_of: Column, no_trades: DataFrame | None = None) -> DataFrame:
    """Per established event: status on the validation day as of an instant, with the first strict break and the observed extreme.

    NOT_APPLICABLE if the event broke before the day's 09:30; INVALIDATED at the first bar strictly beyond. Else MONITORING until the
    day has closed, or has no next date yet; then INCOMPLETE unless bars and proven slots without trade (no_trades: symbol,
    trading_date, slot) cover its 48 slots exactly, NO_TRADE without bars, and PASSED."""
    e = events.filter("established_at is not null").withColumn("trading_date", F.to_date("established_at")).join(calendar, "trading_date", "left")
    bars = bars5.filter(F.col("eob") <= as_of).select("symbol", F.col("trading_date").alias("next_date"), F.col("eob").alias("bar_eob"), "slot", "high_ticks", "low_ticks")
    top = F.col("side") == "TOP"
    reach = F.when(top, F.col("high_ticks")).otherwise(F.col("low_ticks"))
    broken = F.when(top, reach > F.col("ticks")).otherwise(reach < F.col("ticks"))
    seen = e.join(bars, ["symbol", "next_date"]).groupBy("event_key").agg(
        F.count("*").alias("bars"), F.when(F.first("side") == "TOP", F.max("high_ticks")).otherwise(F.min("low_ticks")).alias("extreme_ticks"),
        F.min(F.when(broken, F.struct("bar_eob", reach.alias("reach")))).alias("hit"),
    )
    days = covered_days(bars5, no_trades).select("symbol", F.col("trading_date").alias("next_date"), "proven", "covered")
    out = e.join(seen, "event_key", "left").join(days, ["symbol", "next_date"], "left")
    at = lambda minute: F.timestamp_add("MINUTE", F.lit(minute), F.col("next_date").cast("timestamp_ntz"))
    status = (
        F.when(F.col("break_eob") < at(570), "NOT_APPLICABLE").when(F.col("hit").isNotNull(), "INVALIDATED").when(F.col("next_date").isNull() | (at(900) > as_of), "MONITORING")
        .when(~F.coalesce("covered", F.lit(False)), "INCOMPLETE").when(F.col("bars").isNull(), "NO_TRADE").otherwise("PASSED")
    )
    out = out.withColumn("validation", status)
    hit = F.when(F.col("validation") == "INVALIDATED", F.col("hit"))
    return out.select(
        "event_key", "symbol", "side", "ticks", "next_date", "validation", F.coalesce("bars", F.lit(0)).alias("bars"), F.coalesce("proven", F.lit(0)).alias("proven"), "extreme_ticks",
        hit["bar_eob"].alias("breached_at"), hit["reach"].alias("breach_ticks"),
    )


def covered_days(bars5: DataFrame, no_trades: DataFrame | None) -> DataFrame:
    """symbol, trading_date, proven, covered: whether each of the 48 slots is a bar or a proof, and none is both or double."""
    rows = bars5.select("symbol", "trading_date", "slot", F.lit(1).alias("bar"))
    if no_trades is not None:
        rows = rows.unionByName(no_trades.select("symbol", "trading_date", "slot", F.lit(0).alias("bar")))
    days = rows.groupBy("symbol", "trading_date").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.count_if(F.col("bar") == 0).alias("proven"))
    return days.withColumn("covered", (F.col("n") == SLOTS) & (F.col("slots") == SLOTS))


def validation_summary(validated: DataFrame, key: list[str]) -> DataFrame:
    """Rows by status and what remains; COMPLETED once nothing is monitored, WITH_ERRORS if days are incomplete."""
    n = lambda *names: F.count_if(F.col("validation").isin(*names))
    out = validated.groupBy(*key).agg(
        F.count("*").alias("total"), n("INVALIDATED").alias("invalidated"), n("PASSED").alias("passed"), n("NO_TRADE").alias("no_trade"), n("NOT_APPLICABLE").alias("not_applicable"),
        n("INCOMPLETE").alias("incomplete"), n("MONITORING").alias("remaining"),
    )
    return out.withColumn("status", F.when(F.col("remaining") > 0, "RUNNING").when(F.col("incomplete") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))


def apply_validation(events: DataFrame, validated: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, pre-images, lifecycle rows): events that broke earlier on the validation day than stored become INVALIDATED with that
    reason; what they were before is kept, and their transition is recorded without notification."""
    v = validated.filter("validation = 'INVALIDATED'").select("event_key", "breached_at", "breach_ticks")
    rows = events.join(v, "event_key", "left")
    earlier = F.col("breached_at").isNotNull() & (F.col("break_eob").isNull() | (F.col("breached_at") < F.col("break_eob")))
    reason = F.when(F.col("side") == "TOP", "NEXT_DAY_TOP_PRICE_BREAK").otherwise("NEXT_DAY_BOTTOM_PRICE_BREAK")
    after = rows.withColumns(
        {
            "stage": F.when(earlier, "INVALIDATED").otherwise(F.col("stage")), "is_active": F.col("is_active") & ~earlier, "break_eob": F.when(earlier, F.col("breached_at")).otherwise(F.col("break_eob")),
            "break_ticks": F.when(earlier, F.col("breach_ticks")).otherwise(F.col("break_ticks")), "invalidation_reason": F.when(earlier, reason),
        }
    ).drop("breached_at", "breach_ticks")
    moved = rows.filter(earlier)
    lifecycle = moved.select("event_key", "symbol", F.lit("INVALIDATED").alias("to_stage"), F.col("breached_at").alias("at"), reason.alias("reason"), F.lit(False).alias("notify"))
    return after, moved.select(*events.columns), lifecycle
