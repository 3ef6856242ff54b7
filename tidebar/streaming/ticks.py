"""Streaming jobs over ticks: preview bars, latest quotes, late rows, breaks of active levels, and what runs for each micro-batch:
bar lifecycle, events of touched symbols, alerts, incremental windows.

The same functions as in batch; each has a test that the stream ends where the batch does. Aggregates carry a watermark, after which
a day's state goes; quotes keep one row a symbol. What a micro-batch writes is idempotent, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebar.functions.session import slot_of
from tidebar.operators.bars import roll_up, ticks_to_bars, with_times
from tidebar.operators.cards import alerts
from tidebar.operators.nextday import validate
from tidebar.operators.pairs import lifecycle, replay
from tidebar.sources import store
from tidebar.sources.versions import VersionedTable, added, without
from tidebar.sources.adapters import tick_rows

LATE = "120 seconds"


def read_ticks(spark: SparkSession, folder: str, symbols: int = 20) -> DataFrame:
    """Ticks of a folder of event files as a stream."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return tick_rows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).filter("value > 0"), symbols)


def fresh(ticks: DataFrame, now: F.Column, max_age: int = 120, ahead: int = 30) -> F.Column:
    """Whether a tick's time, and when it was received if the ticks say so, lie within [now - max_age, now + ahead] seconds; snapshots get 15 seconds."""
    age = F.when(F.col("collection_mode") == "SNAPSHOT_POLL", 15).otherwise(max_age) if "collection_mode" in ticks.columns else F.lit(max_age)
    # to the microsecond: whole seconds of a difference are cut towards zero, which lets up to one second more through at either end
    within = lambda c: F.timestamp_diff("MICROSECOND", F.col(c), now).between(F.lit(-ahead * 1_000_000), F.greatest(age, F.lit(10)).cast("long") * 1_000_000)
    return within("event_time") & within("received_at") if "received_at" in ticks.columns else within("event_time")


def split_late(ticks: DataFrame, now: F.Column, max_age: int = 120) -> tuple[DataFrame, DataFrame]:
    """(fresh ticks, ticks beyond the window), before the watermark drops the latter unseen."""
    ok = F.coalesce(fresh(ticks, now, max_age), F.lit(False))
    return ticks.filter(ok), ticks.filter(~ok)


def with_watermark(ticks: DataFrame, within: str = LATE) -> DataFrame:
    """ticks with _at, their time as the event time of the stream."""
    return ticks.withColumn("_at", F.col("event_time").cast("timestamp")).withWatermark("_at", within)


def dedupe(ticks: DataFrame, within: str = LATE) -> DataFrame:
    """Each tick of a worker's session once, by its sequence where ticks have one, else by its event."""
    key = ["worker_id", "session_id", "worker_sequence"] if "worker_sequence" in ticks.columns else ["worker_id", "event_id"]
    return with_watermark(ticks, within).dropDuplicatesWithinWatermark(key).drop("_at")


def preview_bars(ticks: DataFrame, frequency: str = "1m", within: str = LATE) -> DataFrame:
    """Bars as they stand, in update or complete mode; open and close by event time, whatever the order of arrival. A bar from
    several collection modes is MIXED. State goes a watermark after its day."""
    order, price = F.struct("event_time", "event_id"), F.col("price_ticks")
    mode = F.when(F.min("collection_mode") == F.max("collection_mode"), F.min("collection_mode")).otherwise("MIXED")
    more = [mode.alias("source_mode"), F.when(mode == "MIXED", "PARTIAL").otherwise("PREVIEW").alias("quality")] if "collection_mode" in ticks.columns else []
    day = F.window("_at", "1 day").alias("_day")
    rows = with_watermark(ticks, within).groupBy(day, "symbol", "trading_date", slot_of(F.col("minute"), frequency).alias("slot")).agg(
        F.min_by(price, order).alias("open_ticks"), F.max(price).alias("high_ticks"), F.min(price).alias("low_ticks"), F.max_by(price, order).alias("close_ticks"),
        F.sum("volume").alias("volume"), F.sum(price * F.col("volume")).alias("amount_ticks"), F.count("*").alias("tick_count"), *more,
    )
    return with_times(rows.drop("_day"), frequency)


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """Newest tick of each symbol by time, then source priority where ticks have one, then event; the state is one row a symbol."""
    order = F.struct(*[c for c in ("event_time", "source_priority", "event_id") if c in ticks.columns])
    newest = F.max_by(F.struct("event_time", "price_ticks", "event_id"), order)
    return ticks.groupBy("symbol").agg(newest.alias("q")).select("symbol", "q.*")


LEVEL = ["event_key", "symbol", "side", "ticks", "first_seen_at"]


def first_breaks(ticks: DataFrame, levels: DataFrame) -> DataFrame:
    """Each active level (LEVEL) that a tick after it was first seen passes strictly, once, with the first such tick; an equal price breaks nothing.

    On the day a level was first seen its ticks are looked at one by one. Later days need only their extremes to name the day; in that day all
    ticks are later, so ticks and levels stand in one order by price and the earliest tick before a level in it is the one."""
    top = F.col("side") == "TOP"
    sides = F.explode(F.array(F.lit("TOP"), F.lit("BOTTOM"))).alias("side")
    # the further beyond, the smaller
    reach = lambda c: F.when(top, -F.col(c)).otherwise(F.col(c))
    t = ticks.select("symbol", sides, F.to_date("event_time").alias("day"), F.struct("event_time", "event_id", "price_ticks").alias("tick"), "price_ticks")
    t = t.select("symbol", "side", "day", "tick", reach("price_ticks").alias("reach"))
    own = levels.select(*LEVEL, F.to_date("first_seen_at").alias("day"), reach("ticks").alias("bound"))
    same = own.join(t, ["symbol", "side", "day"]).filter((F.col("reach") < F.col("bound")) & (F.col("tick.event_time") > F.col("first_seen_at")))
    same = same.groupBy(*LEVEL).agg(F.min("tick").alias("tick"))
    days = t.groupBy("symbol", "side", "day").agg(F.min("reach").alias("reach"))
    later = own.withColumnRenamed("day", "since").join(days, ["symbol", "side"]).filter((F.col("day") > F.col("since")) & (F.col("reach") < F.col("bound")))
    later = later.groupBy(*LEVEL, "bound").agg(F.min("day").alias("day"))
    level = F.struct(*LEVEL)
    line = t.join(later.select("symbol", "side", "day").distinct(), ["symbol", "side", "day"], "left_semi").select("symbol", "side", "day", "reach", F.lit(1).alias("kind"), "tick", F.lit(None).cast(own.select(level.alias("l")).schema["l"].dataType).alias("level"))
    line = line.unionByName(later.select("symbol", "side", "day", F.col("bound").alias("reach"), F.lit(0).alias("kind"), F.lit(None).cast(line.schema["tick"].dataType).alias("tick"), level.alias("level")))
    before = Window.partitionBy("symbol", "side", "day").orderBy("reach", "kind").rowsBetween(Window.unboundedPreceding, 0)
    later = line.withColumn("tick", F.min("tick").over(before)).filter("kind = 0").select("level.*", "tick")
    found = same.unionByName(later).groupBy(*LEVEL).agg(F.min("tick").alias("tick"))
    return found.select("event_key", "symbol", "side", "ticks", "tick.event_time", "tick.price_ticks")


def break_lifecycle(broken: DataFrame) -> DataFrame:
    """The transitions of levels that ticks broke."""
    reason = F.when(F.col("side") == "TOP", "TICK_HIGHER_PRICE_BREAK").otherwise("TICK_LOWER_PRICE_BREAK")
    return broken.select("event_key", "symbol", F.lit("INVALIDATED").alias("to_stage"), F.col("event_time").alias("at"), reason.alias("reason"), F.col("price_ticks").alias("break_ticks"))


def break_levels(batch: DataFrame, levels: VersionedTable, batch_id: int) -> DataFrame | None:
    """For each micro-batch: transitions of the levels held that its ticks break, which leave the table. Only buckets of symbols that the batch
    reaches beyond are read and rewritten; a batch that runs again finds none anew (None)."""
    held = levels.version()
    if batch_id <= held.batch_id:
        return None
    symbols = batch.select("symbol").distinct()
    own = [r.b for r in symbols.select(levels.bucket().alias("b")).distinct().collect()]  # at most as many numbers as buckets
    rows = levels.read(held, own)
    if rows is None:
        return None
    moves = store.staged(break_lifecycle(first_breaks(batch, rows.select(*LEVEL))), "tick-breaks")
    levels.change(rows.limit(0), without(moves.select("event_key"), ["event_key"]), batch_id, touched=moves.select("symbol").distinct())
    return moves


def run_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Micro-batches to an idempotent writer; what was there when it started is read, then it stops."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


BAR = ["symbol", "frequency", "trading_date", "slot"]
#: Seconds after its end at which a bar closes, and for how long it can then be revised.
CLOSE_AFTER, REVISE_FOR, REVISE_DAILY_FOR = 3, 120, 300


def bar_lifecycle(held: DataFrame, bars: DataFrame, now: F.Column) -> tuple[DataFrame, DataFrame]:
    """(state, events) after bars (with row_hash, eob) as they stand now, over the state held (BAR, eob, row_hash, closed, revision).

    BarUpdated for a change of a bar that is open, BarClosed once when its end lies CLOSE_AFTER seconds back, whether it changed or not,
    BarRevised for a change of a closed bar within its window; later changes are ignored."""
    new = bars.select(*BAR, F.col("eob").alias("new_eob"), F.col("row_hash").alias("new_hash"))
    both = held.join(new, BAR, "full")
    end = F.coalesce("eob", "new_eob")
    past = F.timestamp_diff("SECOND", end, now)
    due = past >= CLOSE_AFTER
    was_closed = F.coalesce("closed", F.lit(False))
    changed = F.col("new_hash").isNotNull() & ~F.col("new_hash").eqNullSafe(F.col("row_hash"))
    window = F.when(F.col("frequency") == "1d", REVISE_DAILY_FOR).otherwise(REVISE_FOR)
    revised = was_closed & changed & (past <= CLOSE_AFTER + window)
    kind = F.when(~was_closed & due, "BarClosed").when(~was_closed & changed, "BarUpdated").when(revised, "BarRevised")
    rows = both.select(
        *BAR, end.alias("eob"), F.when(was_closed & ~revised, F.col("row_hash")).otherwise(F.coalesce("new_hash", "row_hash")).alias("row_hash"), (was_closed | due).alias("closed"),
        (F.coalesce("revision", F.lit(0)) + revised.cast("int")).alias("revision"), kind.alias("event_type"),
    )
    events = rows.filter("event_type is not null").select(*BAR, "eob", "row_hash", "revision", "event_type")
    return rows.drop("event_type"), events


#: Folders of a batch's ticks, so that a later batch opens only those that can hold its symbols.
TICK_BUCKETS = 64


def event_tables(spark: SparkSession, folder: str) -> tuple[VersionedTable, VersionedTable]:
    """(events by symbol, alerts by their id) of a stream of events under folder."""
    return VersionedTable(spark, f"{folder}/events", ["symbol"]), VersionedTable(spark, f"{folder}/alerts", ["outbox_id"])


def replay_touched(spark: SparkSession, batch: DataFrame, batch_id: int, folder: str) -> None:
    """For each micro-batch, whatever the order of its ticks: keeps them, computes the events of the symbols that it touches anew from the ticks in
    those symbols' folders, and puts them in place of those held, so one that a later tick undoes goes too; alerts are only added. A batch that
    runs again overwrites its own ticks and changes neither table. What follows the first write is an ordinary job of the session."""
    own = f"{folder}/ticks/batch={batch_id}"
    bucket = F.pmod(F.xxhash64("symbol"), F.lit(TICK_BUCKETS)).cast("int")
    batch.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(own)
    touched = store.staged(spark.read.parquet(own).select("symbol").distinct(), "touched")
    buckets = [r.b for r in touched.select(bucket.alias("b")).distinct().collect()]  # at most TICK_BUCKETS numbers
    kept = spark.read.option("basePath", f"{folder}/ticks").parquet(f"{folder}/ticks").filter((F.col("batch") <= batch_id) & F.col("bucket").isin(buckets))
    five = ticks_to_bars(kept.join(touched, "symbol", "left_semi"), "5m")
    events = store.staged(replay({"5m": five} | {f: roll_up(five, f) for f in ("30m", "60m", "1d")}), "touched-events")
    held, sent = event_tables(spark, folder)
    held.change(events, without(touched, ["symbol"]), batch_id, touched=touched)
    sent.change(alerts(lifecycle(events), events), added(["outbox_id"]), batch_id)


def stream_events(ticks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Ticks to events and alerts under folder: at the end what a replay of all ticks gives."""
    # micro-batches compute in a session of their own: under a stream, unions that claim a partitioning can fail to line up
    own = ticks.sparkSession.newSession()
    own.conf.set("spark.sql.unionOutputPartitioning", "false")
    own.conf.set("spark.sql.session.timeZone", ticks.sparkSession.conf.get("spark.sql.session.timeZone"))
    return run_each(ticks, lambda batch, number: replay_touched(own, batch, number, folder), checkpoint)


def monitor_next_day(events: DataFrame, bars5: DataFrame, calendar: DataFrame, no_trades: DataFrame | None = None) -> DataFrame:
    """The next-day validation up to the newest 5-minute bar there is."""
    newest = bars5.agg(F.max("eob")).first()[0]
    return validate(events, bars5, calendar, F.lit(newest).cast("timestamp_ntz"), no_trades)


def run_incremental(bars: DataFrame, out: VersionedTable, work: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> dict[str, str]:
    """Hands work the bars of each frequency from its last processed end on, that bar included, and merges what it returns into `out`; the
    marks (frequency -> last end) are committed with that version, so work and marks are both seen or neither. Returns the marks."""
    marks = out.version().marks
    rows = bars
    if marks:
        last = reduce(lambda rest, x: F.when(F.col("frequency") == x[0], F.lit(x[1]).cast("timestamp_ntz")).otherwise(rest), marks.items(), F.lit(None).cast("timestamp_ntz"))
        rows = bars.filter(last.isNull() | (F.col("eob") >= last))
    seen = rows.groupBy("frequency").agg(F.date_format(F.max("eob"), "yyyy-MM-dd HH:mm:ss").alias("last")).collect()  # a row a frequency
    return out.change(work(rows), merge, marks=marks | {r.frequency: r["last"] for r in seen}).marks


def upsert_latest(batch: DataFrame, current: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest state of each key over the current table and a batch, with its revision counted up where it changed."""
    known = [c for c in current.columns if c != "revision"]
    new = batch.groupBy(*key).agg(F.max_by(F.struct(*known), F.struct(*order)).alias("n"))
    both = current.select(*key, F.struct(*known).alias("o"), "revision").join(new, key, "full")
    newer = F.col("o").isNull() | (F.col("n").isNotNull() & (F.struct(*[F.col(f"n.{c}") for c in order]) > F.struct(*[F.col(f"o.{c}") for c in order])))
    row = F.when(newer, F.col("n")).otherwise(F.col("o"))
    revision = F.when(F.col("o").isNull(), 0).when(newer, F.col("revision") + 1).otherwise(F.col("revision"))
    return both.select(row.alias("r"), revision.alias("revision")).select(*[F.col(f"r.{c}").alias(c) for c in known], "revision")
