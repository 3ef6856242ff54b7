"""Pair-price events: hits on round and double-digit prices, their promotion through longer bars and the strict break that ends them.

The rules are sequential (bar after bar), but every quantity has a set form, so they run as joins and aggregates:
a level breaks at the first later 5-minute bar strictly beyond it; hits of a level with one break are one event; an event is promoted by
the first 30-minute, then 60-minute, then daily bar with exactly its price before the break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.session import ORDER
from tidebar.sources.store import staged

STAGES = ["DISCOVERED", "OBSERVING", "FOCUS", "ESTABLISHED"]
SCORES = [0.25, 0.5, 0.75, 1.0]
KEY = ["symbol", "side", "ticks"]


def pair_kind(ticks: Column, include_round: bool = True) -> Column:
    code = F.pmod(ticks, F.lit(100))
    double = F.when((ticks > 0) & (code != 0) & (code % 11 == 0), "DOUBLE_DIGIT")
    return F.when((ticks > 0) & (code == 0), "ROUND_00").otherwise(double) if include_round else double


def pair_hits(bars: DataFrame, include_round: bool = True) -> DataFrame:
    """A high on a pair price is a TOP, a low a BOTTOM."""
    sides = F.array(F.struct(F.lit("TOP").alias("side"), F.col("high_ticks").alias("ticks")), F.struct(F.lit("BOTTOM").alias("side"), F.col("low_ticks").alias("ticks")))
    out = bars.select("symbol", "trading_date", "frequency", "eob", F.inline(sides))
    return out.withColumns({"pair_kind": pair_kind(F.col("ticks"), include_round), "pair_code": F.pmod("ticks", F.lit(100)).cast("int")}).filter("pair_kind is not null")


def with_breaks(hits5: DataFrame, bars5: DataFrame) -> DataFrame:
    """hits5 with break_eob and break_ticks of the first later bar of the symbol that lies strictly beyond; null if none does.

    First within the hit's own day. For levels left over, the extremes of the later days of the month name the day, for those still left the
    extremes of later months name the month and its days the day; that day's bars name the bar. So a level meets the days of a
    month and the months of its history, never all days or bars. What each step leaves is written to the shared folder."""
    sides = F.array(F.struct(F.lit("TOP").alias("side"), F.col("high_ticks").alias("reach")), F.struct(F.lit("BOTTOM").alias("side"), F.col("low_ticks").alias("reach")))
    reach = bars5.select("symbol", F.col("trading_date").alias("day"), F.col("eob").alias("bar_eob"), F.inline(sides))
    top = F.col("side") == "TOP"
    extreme = F.when(top, F.max("reach")).otherwise(F.min("reach")).alias("reach")
    days = reach.groupBy("symbol", "side", "day").agg(extreme).withColumn("month", F.trunc("day", "month"))
    months = days.groupBy("symbol", "side", F.col("month").alias("to_month")).agg(extreme)
    beyond = F.when(top, F.col("reach") > F.col("ticks")).otherwise(F.col("reach") < F.col("ticks"))
    first = F.min(F.struct("bar_eob", "reach"))
    keys = ["symbol", "side", "ticks", "trading_date", "eob"]
    levels = hits5.select(*keys).distinct()
    same = levels.withColumn("day", F.col("trading_date")).join(reach, ["symbol", "side", "day"]).filter((F.col("bar_eob") > F.col("eob")) & beyond)
    same = staged(same.groupBy(*keys).agg(first.alias("hit")), "breaks-same-day")
    rest = staged(levels.join(same.select(*keys), keys, "left_anti").withColumn("month", F.trunc("trading_date", "month")), "breaks-rest")
    soon = rest.join(days, ["symbol", "side", "month"]).filter((F.col("day") > F.col("trading_date")) & beyond).groupBy(*keys).agg(F.min("day").alias("day"))
    soon = staged(soon, "breaks-same-month")
    far = rest.join(soon.select(*keys), keys, "left_anti").join(months, ["symbol", "side"]).filter((F.col("to_month") > F.col("month")) & beyond)
    far = far.groupBy(*keys).agg(F.min("to_month").alias("month")).join(days, ["symbol", "side", "month"]).filter(beyond).groupBy(*keys).agg(F.min("day").alias("day"))
    later = soon.unionByName(far).join(reach, ["symbol", "side", "day"]).filter(beyond).groupBy(*keys).agg(first.alias("hit"))
    found = same.unionByName(later).select(*keys, F.col("hit.bar_eob").alias("break_eob"), F.col("hit.reach").alias("break_ticks"))
    return hits5.join(found, keys, "left")


def break_groups(broken: DataFrame) -> DataFrame:
    """Events: hits of one level with one break; generation counts a level's events in time."""
    w = Window.partitionBy(*KEY).orderBy("discovered_at")
    out = broken.groupBy(*KEY, "pair_kind", "pair_code", "break_eob", "break_ticks").agg(F.min("eob").alias("discovered_at"), F.max("eob").alias("last_hit_at"), F.count_distinct("eob").alias("hits_5m"))
    key = F.sha2(F.concat_ws("|", "symbol", "side", F.col("ticks").cast("string"), F.date_format("discovered_at", "yyyy-MM-dd HH:mm:ss")), 256)
    return out.withColumn("generation", F.row_number().over(w)).withColumn("event_key", key)


def promote(events: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """observed_at, focused_at, established_at: first bar of 30m, 60m, 1d with equal ticks, not before the last stage and before the break."""
    out = events
    for before, name, frequency in (("discovered_at", "observed_at", "30m"), ("observed_at", "focused_at", "60m"), ("focused_at", "established_at", "1d")):
        h = hits[frequency].select(*KEY, F.col("eob").alias("_eob"))
        got = (
            out.filter(F.col(before).isNotNull()).select("event_key", *KEY, F.col(before).alias("_from"), "break_eob").join(h, KEY)
            .filter((F.col("_eob") >= F.col("_from")) & (F.col("break_eob").isNull() | (F.col("_eob") < F.col("break_eob")))).groupBy("event_key").agg(F.min("_eob").alias(name))
        )
        out = out.join(got, "event_key", "left")
    return out


def assemble(events: DataFrame) -> DataFrame:
    """Stage, status, score, frequency mask, counts and last_seen_at of promoted events."""
    times = ["observed_at", "focused_at", "established_at"]
    level = reduce(lambda a, b: a + b, [F.col(t).isNotNull().cast("int") for t in times])
    broken = F.col("break_eob").isNotNull()
    pick = lambda values: reduce(lambda rest, i: F.when(F.col("promotions") == i, values[i]).otherwise(rest), range(3), F.lit(values[3]))
    out = events.withColumn("promotions", level)
    return out.withColumns(
        {
            "strongest_stage": pick(STAGES),
            "stage": F.when(broken, "INVALIDATED").otherwise(pick(STAGES)),
            "status": F.when(broken, "INVALIDATED").when(F.col("promotions") == 0, "CANDIDATE").otherwise("CONFIRMED"),
            "score": pick(SCORES),
            "timeframe_mask": pick([1, 3, 7, 15]),
            "strongest_frequency": pick(list(ORDER)),
            "frequencies": pick([",".join(list(ORDER)[: i + 1]) for i in range(4)]),
            "confluence": F.col("promotions") + 1,
            "round_00": F.when(F.col("pair_kind") == "ROUND_00", F.col("hits_5m") + F.col("promotions")).otherwise(0),
            "total_hit_count": F.col("hits_5m") + F.col("promotions"),
            "last_seen_at": F.greatest("last_hit_at", *times, "break_eob"),
            "is_active": ~broken,
        }
    )


def lifecycle(events: DataFrame) -> DataFrame:
    """Transitions in time: discovery, promotions, break. Promotions notify; a break does if the event had been observed."""
    top = F.col("side") == "TOP"
    step = lambda to, at, reason, notify: F.struct(F.lit(to).alias("to_stage"), F.col(at).alias("at"), reason.alias("reason"), notify.alias("notify"))
    steps = F.array(
        step("DISCOVERED", "discovered_at", F.lit("FIVE_MINUTE_DISCOVERY"), F.lit(False)),
        step("OBSERVING", "observed_at", F.lit("SAME_PRICE_30M"), F.lit(True)),
        step("FOCUS", "focused_at", F.lit("SAME_PRICE_60M"), F.lit(True)),
        step("ESTABLISHED", "established_at", F.lit("SAME_PRICE_1D"), F.lit(True)),
        step("INVALIDATED", "break_eob", F.when(top, "HIGHER_PRICE_BREAK").otherwise("LOWER_PRICE_BREAK"), F.col("observed_at").isNotNull()),
    )
    return events.select("event_key", "symbol", F.inline(F.filter(steps, lambda s: s["at"].isNotNull())))


def replay(bars: dict[str, DataFrame], include_round: bool = True) -> DataFrame:
    """Events of bars by frequency."""
    hits = {f: pair_hits(b, include_round) for f, b in bars.items()}
    return assemble(promote(break_groups(with_breaks(hits["5m"], bars["5m"])), hits))


def replay_run(bars: dict[str, DataFrame], universe: DataFrame, first: Column, last: Column, include_round: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, symbol results) of a universe's symbols over a range of days; every symbol of the universe has a result, failed if it has
    no bars."""
    own = {f: b.filter(F.col("trading_date").between(first, last)).join(universe.select("symbol"), "symbol", "left_semi") for f, b in bars.items()}
    events = replay(own, include_round)
    count = lambda rows, name: rows.groupBy("symbol").agg(F.count("*").alias(name))
    counted = events.groupBy("symbol").agg(F.count("*").alias("events"), F.sum("total_hit_count").alias("hits"))
    rows = universe.select("symbol").join(count(own["5m"], "bars"), "symbol", "left").join(counted, "symbol", "left")
    status = F.when(F.col("bars").isNull(), "failed").otherwise("complete")
    return events, rows.withColumn("status", status).fillna(0, ["bars", "events", "hits"])


def evidence(events: DataFrame, broken: DataFrame) -> DataFrame:
    """The hits behind events: every 5-minute hit of the event's level and break, and the bar of each promotion."""
    e = events.select("event_key", *KEY, "break_eob", "pair_kind")
    b = broken.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("break_eob").alias("_break"), "eob").distinct()
    same = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_{k}") for k in KEY]) & F.col("break_eob").eqNullSafe(F.col("_break"))
    found = e.join(b, same).select("event_key", "symbol", "side", "ticks", "pair_kind", F.lit("5m").alias("frequency"), F.lit("DISCOVERED").alias("stage"), "eob")
    step = lambda frequency, stage, at: F.struct(F.lit(frequency).alias("frequency"), F.lit(stage).alias("stage"), F.col(at).alias("eob"))
    steps = F.array(step("30m", "OBSERVING", "observed_at"), step("60m", "FOCUS", "focused_at"), step("1d", "ESTABLISHED", "established_at"))
    more = events.select("event_key", "symbol", "side", "ticks", "pair_kind", F.inline(F.filter(steps, lambda x: x["eob"].isNotNull())))
    out = found.unionByName(more)
    return out.withColumn("hit_key", F.sha2(F.concat_ws("|", "event_key", "frequency", F.date_format("eob", "yyyy-MM-dd HH:mm:ss")), 256))


def hit_counters(hits: DataFrame) -> DataFrame:
    """Per event: hits in all, promotions, candidates, and by kind of price."""
    n = lambda c: F.count_if(c)
    candidate = F.col("frequency") == "5m"
    return hits.groupBy("event_key").agg(
        F.count("*").alias("hits"), n(~candidate).alias("promotions"), n(candidate).alias("candidates"), n(F.col("pair_kind") == "ROUND_00").alias("round_00"), n(F.col("pair_kind") == "DOUBLE_DIGIT").alias("double_digit")
    )


def frequency_summary(hits: DataFrame) -> DataFrame:
    """Per event: mask, number, strongest and list of the frequencies that its hits have."""
    bit = F.coalesce(*[F.when(F.col("frequency") == f, F.lit(v)) for f, v in ORDER.items()])
    rows = hits.withColumn("bit", bit).groupBy("event_key").agg(F.bit_or("bit").alias("mask"), F.count_distinct("frequency").alias("confluence"), F.max_by("frequency", "bit").alias("strongest"))
    names = F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(v)) != 0, F.lit(f)) for f, v in ORDER.items()]))
    return rows.withColumn("frequencies", F.array_join(names, ","))


def stage_at(cutoff: Column) -> Column:
    """Stage as it was just before an instant."""
    before = lambda c: F.coalesce(F.col(c) < cutoff, F.lit(False))
    return F.when(before("break_eob"), "INVALIDATED").when(before("established_at"), "ESTABLISHED").when(before("focused_at"), "FOCUS").when(before("observed_at"), "OBSERVING").otherwise("DISCOVERED")


def stock_groups(events: DataFrame, cutoff: Column) -> DataFrame:
    """Per symbol: newest roots by side, counts, and the newest event's stage as of the cutoff; one shuffle."""
    at = events.withColumn("stage_then", stage_at(cutoff))
    top, bottom = F.col("side") == "TOP", F.col("side") == "BOTTOM"
    gone = F.col("stage_then") == "INVALIDATED"
    return at.groupBy("symbol").agg(
        F.max("discovered_at").alias("latest_pivot_at"), F.max(F.when(top, F.col("discovered_at"))).alias("latest_top_at"), F.max(F.when(bottom, F.col("discovered_at"))).alias("latest_bottom_at"),
        F.count("*").alias("events"), F.count_if(top).alias("tops"), F.count_if(bottom).alias("bottoms"), F.count_if(~gone).alias("active"), F.count_if(gone).alias("invalidated"),
        F.max_by("stage_then", F.struct("discovered_at", "event_key")).alias("latest_stage"),
        *([F.max(F.when(F.col("wave_status") == "COMPLETED", F.col("wave_score"))).alias("max_wave_score"), F.max_by("symbol_name", F.struct("discovered_at", "event_key")).alias("symbol_name")] if "wave_score" in events.columns else []),
    )


#: What a list of events can be sorted by.
SORT_KEYS = {"score": "score", "first_seen": "discovered_at", "confluence": "confluence", "hits": "total_hit_count", "last_seen": "last_seen_at"}


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    size = max(1, min(size, 200))
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def event_list(events: DataFrame, sort: str = "score", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """A page by a sort key, ties by event_key, each row with the number of events and of pages."""
    size = max(1, min(size, 200))
    key = F.col(SORT_KEYS[sort])
    totals = events.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    return page(events, [key.desc() if descending else key.asc(), F.asc("event_key")], number, size).join(F.broadcast(totals))  # one row


def invariants(events: DataFrame, hits: DataFrame, moves: DataFrame) -> DataFrame:
    """13 checks that must all count zero, from one pass over events, one over levels, hits and lifecycle each."""
    active, gone = F.col("is_active"), F.col("stage") == "INVALIDATED"
    level = lambda *stages: F.col("stage").isin(*stages)
    off = lambda name, side, held: F.count_if((F.col("side") == side) & gone & held).alias(name)
    seen = events.agg(
        F.count_if(active & gone).alias("active_invalidated_stage"), F.count_if(~active & ~gone).alias("inactive_noninvalidated_stage"),
        F.count_if(level(*STAGES[1:]) & F.col("observed_at").isNull()).alias("observing_without_30m_time"), F.count_if(level(*STAGES[2:]) & F.col("focused_at").isNull()).alias("focus_without_60m_time"),
        F.count_if(level(STAGES[3]) & F.col("established_at").isNull()).alias("established_without_day_time"),
        off("top_invalidated_without_strict_break", "TOP", F.col("break_ticks") <= F.col("ticks")), off("bottom_invalidated_without_strict_break", "BOTTOM", F.col("break_ticks") >= F.col("ticks")),
    )
    twice = events.filter(active).groupBy(*KEY).count().agg(F.count_if(F.col("count") > 1).alias("duplicate_active_level"))
    wrong = lambda name, stage, frequency: F.count_if((F.col("stage") == stage) & (F.col("frequency") != frequency)).alias(name)
    bars = hits.agg(wrong("discovery_not_5m", "DISCOVERED", "5m"), wrong("observing_not_30m", "OBSERVING", "30m"), wrong("focus_not_60m", "FOCUS", "60m"), wrong("established_not_1d", "ESTABLISHED", "1d"))
    told = moves.agg(F.count_if((F.col("to_stage") == "DISCOVERED") & F.col("notify")).alias("discovery_should_notify"))
    rows = [d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n")) for c in d.columns]))) for d in (seen, twice, bars, told)]
    return reduce(DataFrame.unionByName, rows)
