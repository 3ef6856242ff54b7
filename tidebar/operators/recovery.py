"""Recovery of bars: retraction, classes of gaps, ranges to compute anew, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators import pairs
from tidebar.sources.store import staged

SLOT = ["symbol", "frequency", "trading_date", "slot"]
#: Minute bars are no longer to be had after so many days.
EXPIRED_DAYS = 60


def apply_retractions(bars: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, missing marks) by the newest read (read_at) of a slot: a proven missing slot removes an older bar, a bar as new or newer
    removes the mark."""
    seen = bars.groupBy(*SLOT).agg(F.max("read_at").alias("_bar"))
    gone = missing.groupBy(*SLOT).agg(F.max("read_at").alias("_gone"))
    left = bars.join(gone.join(seen, SLOT).filter("_gone > _bar").select(*SLOT), SLOT, "left_anti")
    return left, missing.join(seen.join(gone, SLOT).filter("_bar >= _gone").select(*SLOT), SLOT, "left_anti")


def classify_gaps(slots: DataFrame, now: Column, grace: int = 90) -> DataFrame:
    """gap_class of expected slots, each with what is known of it: end (when it closed), local_hash, official_hash, confirmed, proven (no
    trade), later (whether a later slot of the day is there). Null where nothing is wrong."""
    have, official = F.col("local_hash").isNotNull(), F.col("official_hash").isNotNull()
    old = F.col("frequency").isin("1m", "5m", "30m", "60m") & (F.datediff(now, F.col("end")) > EXPIRED_DAYS)
    young = F.timestamp_diff("SECOND", F.col("end"), now) < grace
    kind = (
        F.when(F.col("proven"), "verified_no_bar").when(have & official & (F.col("local_hash") != F.col("official_hash")), "source_mismatch").when(have & ~F.col("confirmed"), "stale_unconfirmed")
        .when(have, None).when(old, "source_expired").when(young, "source_delayed").when(F.col("later"), "sequence_gap").otherwise("missing_slot")
    )
    return slots.withColumn("gap_class", kind)


def affected_ranges(changed: DataFrame, look_back: dict[str, int], slots: dict[str, int]) -> DataFrame:
    """Runs of neighbouring changed slots (symbol, frequency, ordinal: the slot's number over all trading days), each with the first slot
    to compute anew: its frequency's look-back before the run; ranges that then meet are one."""
    back = F.coalesce(*[F.when(F.col("frequency") == f, F.lit(n)) for f, n in look_back.items()], F.lit(0))
    w = Window.partitionBy("symbol", "frequency").orderBy("ordinal")
    rows = changed.select("symbol", "frequency", "ordinal").distinct().withColumn("from_ordinal", F.greatest(F.col("ordinal") - back, F.lit(0)))
    new = F.coalesce((F.col("from_ordinal") > F.lag("ordinal").over(w) + 1).cast("int"), F.lit(1))
    rows = rows.withColumn("_run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("symbol", "frequency", "_run").agg(F.min("ordinal").alias("earliest"), F.max("ordinal").alias("latest"), F.min("from_ordinal").alias("from_ordinal"), F.count("*").alias("changed"))
    days = F.coalesce(*[F.when(F.col("frequency") == f, F.lit(n)) for f, n in slots.items()], F.lit(1))
    return out.withColumn("from_day", F.floor(F.col("from_ordinal") / days)).drop("_run")


def changed_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Slots (SLOT) whose bar came, went or has another row_hash."""
    both = old.select(*SLOT, F.col("row_hash").alias("_old")).join(new.select(*SLOT, F.col("row_hash").alias("_new")), SLOT, "full")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*SLOT)


def affected_days(changed: DataFrame, calendar: DataFrame, look_back: dict[str, int], slots: dict[str, int]) -> DataFrame:
    """Per symbol the first day to compute anew (from_day), by its affected ranges. calendar: trading_date."""
    number = F.row_number().over(Window.orderBy("trading_date")) - 1  # a row a trading day
    days = calendar.select("trading_date").distinct().withColumn("number", number)
    per_day = F.coalesce(*[F.when(F.col("frequency") == f, F.lit(n)) for f, n in slots.items()], F.lit(1))
    numbered = changed.join(days, "trading_date").withColumn("ordinal", F.col("number") * per_day + F.col("slot"))
    first = affected_ranges(numbered, look_back, slots).groupBy("symbol").agg(F.min("from_day").alias("number"))
    return first.join(days, "number").select("symbol", F.col("trading_date").alias("from_day"))


def recompute(events: DataFrame, hits: DataFrame, bars: dict[str, DataFrame], days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, keys that are gone) after the bars of some symbols have changed from a day on. days: symbol, from_day.

    Nothing before from_day is read again: events that broke before it stay as they are; of those still open then the stored hits (`pairs.evidence`)
    stand for what came before, so they go on with their first hit, their key and the stages that they had; the rest follows from the
    bars since. events are all events: those of other symbols, those that stay and those computed anew."""
    start = F.col("from_day").cast("timestamp_ntz")
    touched = events.join(days, "symbol")
    stays = F.coalesce(F.col("break_eob") < start, F.lit(False))
    past = touched.filter(stays).drop("from_day")
    left = touched.filter(~stays)
    before = hits.join(left.filter(F.col("discovered_at") < start).select("event_key", "from_day"), "event_key").filter(F.col("eob") < start)
    before = before.select("symbol", F.to_date("eob").alias("trading_date"), "frequency", "eob", "side", "ticks", "pair_kind", F.pmod("ticks", F.lit(100)).cast("int").alias("pair_code"))
    own = {f: b.join(days, "symbol").filter(F.col("trading_date") >= F.col("from_day")).drop("from_day") for f, b in bars.items()}
    found = {f: pairs.pair_hits(b).unionByName(before.filter(F.col("frequency") == f)) for f, b in own.items()}
    fresh = pairs.break_groups(pairs.with_breaks(found["5m"], own["5m"]))
    earlier = past.groupBy(*pairs.KEY).agg(F.count("*").alias("_earlier"))
    fresh = fresh.join(earlier, pairs.KEY, "left").withColumn("generation", (F.col("generation") + F.coalesce("_earlier", F.lit(0))).cast("int")).drop("_earlier")
    fresh = staged(pairs.assemble(pairs.promote(fresh, found)), "recomputed-events")
    others = events.join(days.select("symbol"), "symbol", "left_anti")
    columns = events.columns
    return others.unionByName(past.select(*columns)).unionByName(fresh.select(*columns)), left.select("event_key").join(fresh.select("event_key"), "event_key", "left_anti")


def status_rollup(parents: DataFrame, children: DataFrame, key: str, states: list[str]) -> DataFrame:
    """Per parent: children, those in each state, and attempts."""
    counted = children.groupBy(key).agg(F.count("*").alias("children"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.sum("attempts").alias("attempts"))
    return parents.join(counted, key, "left").fillna(0, ["children", *states, "attempts"])


def run_summary(results: DataFrame) -> DataFrame:
    """Of a run's symbols (status complete or failed, bars, hits, events): counts, sums over the complete ones, and its status."""
    done = F.col("status") == "complete"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).alias(c)
    out = results.agg(F.count_if(done).alias("completed_symbols"), F.count_if(F.col("status") == "failed").alias("failed_symbols"), total("bars"), total("hits"), total("events"))
    return out.withColumn("run_status", F.when(F.col("failed_symbols") > 0, "partial").otherwise("complete"))


def symbol_results(universe: DataFrame, bars: DataFrame, hits: DataFrame, events: DataFrame) -> DataFrame:
    """What a replay of the universe's symbols did; a symbol without a bar failed."""
    count = lambda rows, name: rows.groupBy("symbol").agg(F.count("*").alias(name))
    rows = universe.select("symbol").distinct()
    for found, name in ((bars, "bars"), (hits, "hits"), (events, "events")):
        rows = rows.join(count(found, name), "symbol", "left")
    return rows.fillna(0, ["bars", "hits", "events"]).withColumn("status", F.when(F.col("bars") > 0, "complete").otherwise("failed"))
