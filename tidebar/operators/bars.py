"""Bars: building, roll-up, validity, identity, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.session import MINUTES, SLOTS, slot_begin, slot_end, slot_of

OHLC = ["open_ticks", "high_ticks", "low_ticks", "close_ticks"]
FACTS = [*OHLC, "volume", "amount_ticks"]
OFFICIAL_PRIORITY = 300


def _ohlc(order: Column, price: Column) -> list[Column]:
    return [F.min_by(price, order).alias("open_ticks"), F.max(price).alias("high_ticks"), F.min(price).alias("low_ticks"), F.max_by(price, order).alias("close_ticks")]


def ticks_to_bars(ticks: DataFrame, frequency: str) -> DataFrame:
    """OHLCV bars of a frequency; open and close by event time, then event id; no bar without a tick."""
    order = F.struct("event_time", "event_id")
    price = F.col("price_ticks")
    rows = ticks.groupBy("symbol", "trading_date", slot_of(F.col("minute"), frequency).alias("slot")).agg(
        *_ohlc(order, price), F.sum("volume").alias("volume"), F.sum(price * F.col("volume")).alias("amount_ticks"),
        F.min("event_time").alias("first_tick"), F.max("event_time").alias("last_tick"), F.count("*").alias("tick_count"),
    )
    return with_times(rows, frequency)


def with_times(rows: DataFrame, frequency: str) -> DataFrame:
    date, slot = F.col("trading_date"), F.col("slot")
    return rows.withColumns({"frequency": F.lit(frequency), "bob": slot_begin(date, slot, frequency), "eob": slot_end(date, slot, frequency)})


def active_bars(ticks: DataFrame, frequencies: list[str]) -> DataFrame:
    """Bars of several frequencies from one pass over the ticks."""
    pairs = F.array(*[F.struct(F.lit(f).alias("frequency"), slot_of(F.col("minute"), f).alias("slot")) for f in frequencies])
    order = F.struct("event_time", "event_id")
    return (
        ticks.withColumn("_p", F.explode(pairs)).select("*", "_p.frequency", "_p.slot").groupBy("symbol", "trading_date", "frequency", "slot")
        .agg(*_ohlc(order, F.col("price_ticks")), F.sum("volume").alias("volume"), F.count("*").alias("tick_count"))
    )


def roll_up(bars5: DataFrame, frequency: str) -> DataFrame:
    """Longer bars from 5-minute bars, with how many components came of how many expected."""
    size = MINUTES[frequency] // 5
    order = F.col("slot")
    rows = bars5.withColumn("_to", F.floor(F.col("slot") / size).cast("int")).groupBy("symbol", "trading_date", "_to").agg(
        F.min_by("open_ticks", order).alias("open_ticks"), F.max("high_ticks").alias("high_ticks"), F.min("low_ticks").alias("low_ticks"), F.max_by("close_ticks", order).alias("close_ticks"),
        F.sum("volume").alias("volume"), F.sum("amount_ticks").alias("amount_ticks"), F.count("*").alias("component_count"),
    )
    return with_times(rows.withColumnRenamed("_to", "slot").withColumn("expected_component_count", F.lit(size)), frequency)


def week_of(date: Column) -> Column:
    """The Monday of a date's week."""
    return F.to_date(F.date_trunc("week", date))


def weekly(daily: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Monday weeks; with as_of only those completed before its week. Revisions and row hashes are carried along where bars have them."""
    order = F.col("trading_date")
    rows = daily if as_of is None else daily.filter(week_of(order) < week_of(as_of))
    more = [F.max("revision").alias("revision")] if "revision" in daily.columns else []
    if "row_hash" in daily.columns:
        more.append(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "row_hash"))), lambda x: x["row_hash"]), ":").alias("row_hash"))
    return rows.groupBy("symbol", week_of(order).alias("week")).agg(
        F.min_by("open_ticks", order).alias("open_ticks"), F.max("high_ticks").alias("high_ticks"), F.min("low_ticks").alias("low_ticks"), F.max_by("close_ticks", order).alias("close_ticks"),
        F.sum("volume").alias("volume"), F.count("*").alias("days"), *more,
    )


def valid() -> Column:
    """Prices above zero, high and low around open and close, nothing negative."""
    o, h, low, c = (F.col(x) for x in OHLC)
    whole = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
    return F.coalesce(whole & (F.least(o, h, low, c) > 0) & (h >= F.greatest(o, c, low)) & (low <= F.least(o, c)) & (F.col("volume") >= 0) & (F.col("amount_ticks") >= 0), F.lit(False))


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    return bars.filter(valid()), bars.filter(~valid())


def with_row_hash(bars: DataFrame) -> DataFrame:
    return bars.withColumn("row_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in FACTS]), 256))


def dedupe_conflicts(bars: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row per key whose rows all agree, keys with several hashes)."""
    rows = bars.groupBy(*key).agg(F.min("row_hash").alias("row_hash"), F.count_distinct("row_hash").alias("hashes"), F.count("*").alias("copies"))
    return rows.filter("hashes = 1").drop("hashes"), rows.filter("hashes > 1")


def merge_bars(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The merged table with what happened: BarClosed for a new key, BarRevised for another hash over a stored priority of
    at most OFFICIAL_PRIORITY, null otherwise. Rows: key, row_hash, revision, source_priority, event_type, event_id."""
    s = stored.select(*key, F.col("row_hash").alias("_hash"), F.col("revision").alias("_revision"), F.col("source_priority").alias("_priority"))
    i = incoming.select(*key, "row_hash", "source_priority")
    both = s.join(i, key, "full")
    new = F.col("_hash").isNull()
    revised = F.col("row_hash").isNotNull() & (F.col("row_hash") != F.col("_hash")) & (F.col("_priority") <= OFFICIAL_PRIORITY)
    event = F.when(new, "BarClosed").when(revised, "BarRevised")
    changed = new | revised
    out = both.select(
        *key,
        F.when(changed, F.col("row_hash")).otherwise(F.col("_hash")).alias("row_hash"),
        F.when(new, 0).when(revised, F.col("_revision") + 1).otherwise(F.col("_revision")).alias("revision"),
        F.when(changed, F.col("source_priority")).otherwise(F.col("_priority")).alias("source_priority"),
        event.alias("event_type"),
    )
    text = F.concat_ws("|", F.lit("official"), *[F.col(k).cast("string") for k in key], F.col("revision").cast("string"), F.col("row_hash"))
    return out.withColumn("event_id", F.when(F.col("event_type").isNotNull(), F.concat(F.lit("sha256:"), F.sha2(text, 256))))


def reconciled(stored: DataFrame, merged: DataFrame, key: list[str]) -> DataFrame:
    """What a merge revised: key, old_hash, new_hash, revision."""
    old = stored.select(*key, F.col("row_hash").alias("old_hash"))
    return merged.filter("event_type = 'BarRevised'").join(old, key).select(*key, "old_hash", F.col("row_hash").alias("new_hash"), "revision")


def checkpoints(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "frequency").agg(F.max("eob").alias("last_eob"), F.count("*").alias("bars"))


def with_volume_delta(ticks: DataFrame) -> DataFrame:
    """Volume that each tick adds, ticks taken as they arrive (by event_id): its own trade volume where it has one (last_volume), else
    the rise of the cumulative volume over all before it in the day, never below zero; none for a tick older than one before it."""
    before = Window.partitionBy("symbol", "trading_date").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.col("event_time") < F.max("event_time").over(before), F.lit(False))
    rise = F.greatest(F.col("cumulative_volume") - F.coalesce(F.max("cumulative_volume").over(before), F.lit(0)), F.lit(0))
    return ticks.withColumn("volume_delta", F.when(late, 0).otherwise(F.coalesce("last_volume", rise)))


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Newest tick of each symbol, later ids winning ties."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("event_time", "price_ticks", "event_id"), F.struct("event_time", "event_id")).alias("q")).select("symbol", "q.*")


def expected_slots(symbol_days: DataFrame, frequency: str, cutoff: Column | None = None, grace: int = 90) -> DataFrame:
    """All slots of the symbols' days; with a cutoff those that ended at least `grace` seconds before it."""
    slots = symbol_days.select("symbol", "trading_date", F.explode(F.sequence(F.lit(0), F.lit(SLOTS[frequency] - 1))).alias("slot"))
    if cutoff is None:
        return slots
    return slots.filter(F.timestamp_add("SECOND", F.lit(grace), slot_end(F.col("trading_date"), F.col("slot"), frequency)) <= cutoff)


def missing_slots(symbol_days: DataFrame, bars: DataFrame, frequency: str, cutoff: Column | None = None) -> DataFrame:
    return expected_slots(symbol_days, frequency, cutoff).join(bars.select("symbol", "trading_date", "slot"), ["symbol", "trading_date", "slot"], "left_anti")


def islands(missing: DataFrame) -> DataFrame:
    """Runs of neighbouring missing slots of a day."""
    w = Window.partitionBy("symbol", "trading_date").orderBy("slot")
    run = missing.withColumn("_run", F.col("slot") - F.row_number().over(w))
    return run.groupBy("symbol", "trading_date", "_run").agg(F.min("slot").alias("from_slot"), F.max("slot").alias("to_slot"), F.count("*").alias("missing")).drop("_run")


def detect_gaps(symbol_days: DataFrame, bars: DataFrame, frequency: str, cutoff: Column | None = None) -> DataFrame:
    """Runs of missing slots with a key and a severity (error for daily bars, else warning)."""
    rows = islands(missing_slots(symbol_days, bars, frequency, cutoff))
    text = F.concat_ws("|", "symbol", F.lit(frequency), F.date_format("trading_date", "yyyy-MM-dd"), F.col("from_slot").cast("string"), F.col("to_slot").cast("string"))
    return rows.withColumns({"gap_key": F.sha2(text, 256), "frequency": F.lit(frequency), "severity": F.lit("error" if frequency == "1d" else "warning")})


def gap_totals(symbol_days: DataFrame, bars: DataFrame, frequency: str, cutoff: Column | None = None) -> DataFrame:
    """Expected, existing and missing slots."""
    slot = ["symbol", "trading_date", "slot"]
    both = expected_slots(symbol_days, frequency, cutoff).join(bars.select(*slot, F.lit(1).alias("is")), slot, "left")
    return both.agg(F.count("*").alias("expected"), F.count("is").alias("existing"), F.count_if(F.col("is").isNull()).alias("missing"))


def last_n(bars: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy(F.desc("eob"))
    return bars.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n)


def quality_issues(bars: DataFrame, symbol_days: DataFrame, frequency: str) -> DataFrame:
    """Broken rules by symbol and day: OHLC, negative volume, repeated slots, slots off the grid, missing slots, incomplete components
    where the table has them."""
    day = ["symbol", "trading_date"]
    rules = {
        ("invalid_ohlc", "error"): ~valid(), ("negative_volume", "error"): F.col("volume") < 0,
        ("slot_misaligned", "error"): F.col("slot").isNull() | ~F.col("slot").between(0, SLOTS[frequency] - 1),
    }
    if "component_count" in bars.columns:
        rules["incomplete_components", "warning"] = F.col("component_count") < F.col("expected_component_count")
    counts = bars.groupBy(*day).agg(*[F.count_if(rule).alias(name) for (name, _), rule in rules.items()])
    each = F.array(*[F.struct(F.lit(name).alias("check_type"), F.lit(severity).alias("severity"), F.col(name).alias("n")) for name, severity in rules])
    out = counts.select(*day, F.inline(each)).filter("n > 0")
    twice = bars.groupBy(*day, "slot").count().filter("count > 1").groupBy(*day).agg(F.sum(F.col("count") - 1).alias("n"))
    gone = missing_slots(symbol_days, bars, frequency).groupBy(*day).agg(F.count("*").alias("n"))
    for rows, name, severity in ((twice, "duplicate_slots", "error"), (gone, "missing_slots", "warning")):
        out = out.unionByName(rows.select(*day, F.lit(name).alias("check_type"), F.lit(severity).alias("severity"), "n"))
    return out


def compare_sources(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Fields in which two sources of the same bars differ, with both values; a row that only one side has differs in all."""
    x = a.select(*key, *[F.col(f).alias(f"a_{f}") for f in fields])
    y = b.select(*key, *[F.col(f).alias(f"b_{f}") for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in fields])
    return x.join(y, key, "full").select(*key, F.inline(each)).filter("not (a <=> b)")
