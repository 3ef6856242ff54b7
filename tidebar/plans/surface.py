"""Registered queries of the query surface, recovery, cards and jobs, each with its SQL."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.session import slot_end
from tidebar.operators import bars as B
from tidebar.operators import cards as C
from tidebar.operators import daily as D
from tidebar.operators import maintain as M
from tidebar.operators import nextday as N
from tidebar.operators import pairs as P
from tidebar.operators import recovery as R
from tidebar.operators import signals as S
from tidebar.operators import surface as Q
from tidebar.operators import universe as U
from tidebar.plans.market import CUTOFF, EVENTS, HITS, QUERIES, SQL, TICKS, bars_sql, cutoff, day, events, frames, intraday, query, replayed, stamp, text
from tidebar.plans.operations import UNIVERSE, universe
from tidebar.plans.research import AHEAD, BASE, ROLLED, SIGNALS, rounded
from tidebar.sources import adapters as A
from tidebar.sources import store

__all__ = ["QUERIES", "SQL"]

FIRST, END = date(2024, 1, 5), date(2024, 1, 25)
_STAGE = f"CASE WHEN break_eob < TIMESTAMP '{CUTOFF}' THEN 'INVALIDATED' WHEN established_at < TIMESTAMP '{CUTOFF}' THEN 'ESTABLISHED' WHEN focused_at < TIMESTAMP '{CUTOFF}' THEN 'FOCUS' WHEN observed_at < TIMESTAMP '{CUTOFF}' THEN 'OBSERVING' ELSE 'DISCOVERED' END"
# wave results and names stand in by price and symbol
PROJECTION = f"""{EVENTS}, pr AS (SELECT *, 'Stock ' || symbol AS symbol_name, CASE WHEN ticks % 3 = 0 THEN 'COMPLETED' WHEN ticks % 3 = 1 THEN 'PENDING' END AS wave_status, CASE WHEN ticks % 3 = 0 THEN CASE WHEN ticks % 101 >= 85 THEN 'STRONG' WHEN ticks % 101 >= 70 THEN 'CANDIDATE' ELSE 'NONE' END END AS wave_signal,
 CASE WHEN ticks % 3 = 0 THEN CAST(ticks % 101 AS INTEGER) END AS wave_score, timeframe_mask AS frequency_mask, {_STAGE} AS stage_then FROM ev)"""


def scored(rows: DataFrame) -> DataFrame:
    third, score = F.col("ticks") % 3 == 0, (F.col("ticks") % 101).cast("int")
    signal = F.when(score >= 85, "STRONG").when(score >= 70, "CANDIDATE").otherwise("NONE")
    return rows.withColumns({"symbol_name": F.concat(F.lit("Stock "), "symbol"), "wave_status": F.when(third, "COMPLETED").when(F.col("ticks") % 3 == 1, "PENDING"), "wave_signal": F.when(third, signal), "wave_score": F.when(third, score)})


def projection(spark: SparkSession, folder: str) -> DataFrame:
    """The stored projection: built by the first query that asks, anew if the ticks' files change."""
    return store.kept(spark, "projection", [f"{folder}/events.parquet"], lambda: Q.build_projection(scored(events(spark, folder))))


_PROJECTED = "event_key, symbol, symbol_name, side, stage, is_active, frequencies, frequency_mask, wave_status, wave_signal, wave_score"


@query("projection", f"{PROJECTION} SELECT {_PROJECTED}, {stamp('discovered_at')}, {stamp('observed_at')}, {stamp('focused_at')}, {stamp('established_at')}, {stamp('break_eob')} FROM pr")
def projection_rows(spark: SparkSession, folder: str) -> DataFrame:
    times = text("discovered_at", "observed_at", "focused_at", "established_at", "break_eob")
    return Q.require_root(projection(spark, folder)).select(*_PROJECTED.split(", "), *[c.alias(n) for n, c in times.items()])


@query("projection_diff", f"{PROJECTION} SELECT event_key FROM pr WHERE ticks % 10 = 3 OR ticks % 10 = 4")
def projection_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The stored projection against one built from events of which some have changed and some gone."""
    e = scored(events(spark, folder)).filter("ticks % 10 <> 3").withColumn("symbol_name", F.when(F.col("ticks") % 10 == 4, "other").otherwise(F.col("symbol_name")))
    return M.difference(projection(spark, folder), Q.build_projection(e), ["event_key"])


_GROUPED = f"""g AS (SELECT symbol, max(discovered_at) AS latest_pivot_at, max(discovered_at) FILTER (side = 'TOP') AS latest_top_at, max(discovered_at) FILTER (side = 'BOTTOM') AS latest_bottom_at, count(*) AS events, count(*) FILTER (side = 'TOP') AS tops, count(*) FILTER (side = 'BOTTOM') AS bottoms,
 count(*) FILTER (stage_then <> 'INVALIDATED') AS active, count(*) FILTER (stage_then = 'INVALIDATED') AS invalidated, arg_max(stage_then, (discovered_at, event_key)) AS latest_stage, max(wave_score) FILTER (wave_status = 'COMPLETED') AS max_wave_score, arg_max(symbol_name, (discovered_at, event_key)) AS symbol_name FROM f GROUP BY symbol)"""
_RANGE = f"discovered_at >= TIMESTAMP '{FIRST} 00:00:00' AND discovered_at < TIMESTAMP '{END} 00:00:00'"
_GROUP_TIMES = "latest_pivot_at latest_top_at latest_bottom_at".split()


def _group_sql(where: str, order: str, size: int, offset: int) -> str:
    return f"""{PROJECTION}, f AS (SELECT * FROM pr WHERE {where}), {_GROUPED} SELECT g.* REPLACE ({', '.join(f"strftime(g.{c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in _GROUP_TIMES)}), (SELECT count(*) FROM g) AS total_groups FROM g ORDER BY {order} LIMIT {size} OFFSET {offset}"""


@query("stock_groups_page", _group_sql(_RANGE, "g.latest_pivot_at DESC, symbol", 8, 8))
def stock_groups_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.filter_projection(projection(spark, folder), FIRST, END, cutoff())
    return Q.group_page(rows, cutoff(), number=2, size=8).withColumns(text(*_GROUP_TIMES))


@query("stock_groups_by_score", _group_sql(f"{_RANGE} AND side = 'BOTTOM' AND frequency_mask & 2 <> 0 AND wave_status = 'COMPLETED' AND wave_signal IN ('CANDIDATE', 'STRONG')", "max_wave_score DESC NULLS LAST, g.latest_pivot_at DESC, symbol", 50, 0))
def stock_groups_by_score(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.filter_projection(projection(spark, folder), FIRST, END, cutoff(), side="bottom", frequency="30m", signal="SIGNALLED")
    return Q.group_page(rows, cutoff(), sort="wave_score").withColumns(text(*_GROUP_TIMES))


@query("group_total", f"{PROJECTION} SELECT count(DISTINCT symbol) AS total_groups FROM pr WHERE {_RANGE} AND contains(upper(symbol_name), 'K U1') AND stage_then <> 'INVALIDATED'")
def group_total(spark: SparkSession, folder: str) -> DataFrame:
    return Q.count_groups(Q.filter_projection(projection(spark, folder), FIRST, END, cutoff(), word=" k u1 ", invalidated=False))


@query("group_latest", f"{PROJECTION}, f AS (SELECT * FROM pr WHERE {_RANGE} AND stage_then <> 'INVALIDATED'), m AS (SELECT symbol, max(discovered_at) AS d FROM f GROUP BY symbol) SELECT m.symbol, strftime(d, '%Y-%m-%d %H:%M:%S') AS latest_pivot_at, arg_max(event_key, event_key) AS event_key, arg_max(wave_score, event_key) AS wave_score FROM m JOIN f ON f.symbol = m.symbol AND discovered_at = d GROUP BY m.symbol, d")
def group_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.filter_projection(projection(spark, folder), FIRST, END, cutoff(), active=True)
    groups = Q.groups(rows, cutoff()).select("symbol", "latest_pivot_at")
    return Q.with_latest(groups, rows, ["event_key", "wave_score"]).withColumns(text("latest_pivot_at"))


@query("event_timeline", f"{PROJECTION} SELECT event_key, symbol, wave_score, {stamp('discovered_at')} FROM pr WHERE {_RANGE} AND symbol = 'U3' ORDER BY CASE WHEN wave_status = 'COMPLETED' THEN wave_score END DESC NULLS LAST, pr.discovered_at DESC, event_key DESC LIMIT 40")
def event_timeline(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.filter_projection(projection(spark, folder), FIRST, END, cutoff(), symbol="u3")
    return Q.timeline(rows, sort="wave_score", size=40).select("event_key", "symbol", "wave_score", text("discovered_at")["discovered_at"].alias("discovered_at"))


@query("event_filter", f"{PROJECTION} SELECT event_key, symbol, stage, score FROM pr WHERE side = 'TOP' AND contains(upper(symbol), 'U1') AND list_contains(string_split(frequencies, ','), '60m') AND score >= 0.5 AND last_seen_at >= TIMESTAMP '{FIRST} 00:00:00' AND last_seen_at < TIMESTAMP '2024-01-26 00:00:00' AND pair_kind = 'DOUBLE_DIGIT'")
def event_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.filter_events(events(spark, folder), side="top", word="u1", frequency="3600s", least_score=0.5, first=FIRST, last=END, kind="double_digit")
    return rows.select("event_key", "symbol", "stage", "score")


@query("visible_events", f"{EVENTS} SELECT event_key, stage FROM ev WHERE stage NOT IN ('DISCOVERED', 'INVALIDATED') AND pair_code % 11 = 0 AND status = 'CONFIRMED'")
def visible_events(spark: SparkSession, folder: str) -> DataFrame:
    return Q.filter_events(events(spark, folder), visible=True, status="confirmed").select("event_key", "stage")


@query(
    "event_details",
    f"""{HITS}, h AS (SELECT event_key, string_agg(strftime(eob, '%Y-%m-%d %H:%M') || ' ' || frequency, ';' ORDER BY eob, frequency) AS hits FROM evidence GROUP BY event_key), m AS (SELECT event_key, string_agg(strftime(moment, '%Y-%m-%d %H:%M') || ' ' || to_stage, ';' ORDER BY moment, to_stage) AS moves FROM moves GROUP BY event_key)
SELECT ev.event_key, symbol, hits, moves FROM ev LEFT JOIN h USING (event_key) LEFT JOIN m USING (event_key)""",
)
def event_details(spark: SparkSession, folder: str) -> DataFrame:
    joined = lambda a, at, name: F.array_join(F.transform(a, lambda x: F.concat_ws(" ", F.date_format(x[at], "yyyy-MM-dd HH:mm"), x[name])), ";").alias(a)
    return Q.detail_rows(*replayed(spark, folder)).select("event_key", "symbol", joined("hits", "eob", "frequency"), joined("moves", "at", "to_stage"))


OFFICIAL = f"""WITH {TICKS}, {bars_sql('5m', 'b5')}, {bars_sql('30m', 'b30')}, c AS (SELECT symbol, trading_date, CAST(floor(slot / 6) AS INTEGER) AS slot, count(*) AS component_count FROM b5 GROUP BY ALL), o AS (SELECT b30.*, component_count, volume % 7 <> 0 AS official_confirmed, CASE WHEN volume % 5 = 0 THEN 200 ELSE 300 END AS source_priority, CASE WHEN volume % 11 = 0 THEN 'failed' ELSE 'passed' END AS quality_status FROM b30 JOIN c USING (symbol, trading_date, slot))"""


def official(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.roll_up(B.ticks_to_bars(A.ticks(spark, folder), "5m"), "30m")
    n = F.col("volume")
    return rows.withColumns({"official_confirmed": n % 7 != 0, "source_priority": F.when(n % 5 == 0, 200).otherwise(300), "quality_status": F.when(n % 11 == 0, "failed").otherwise("passed")})


@query("official_scan", f"{OFFICIAL} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, close_ticks FROM o WHERE o.trading_date BETWEEN DATE '{FIRST}' AND DATE '{END}' AND official_confirmed AND source_priority >= 300 AND quality_status = 'passed' AND component_count = 6 AND symbol IN ('U1', 'U2', 'U3', 'U14')")
def official_scan(spark: SparkSession, folder: str) -> DataFrame:
    return Q.scan_bars(official(spark, folder), "30m", FIRST, END, ["U1", "U2", "U3", "U14"]).select("symbol", day(), "slot", "close_ticks")


@query("bar_range", f"{OFFICIAL}, l AS (SELECT * FROM o WHERE symbol = 'U5' AND o.trading_date BETWEEN DATE '{FIRST}' AND DATE '{END}' ORDER BY o.eob DESC LIMIT 60) SELECT symbol, close_ticks, {stamp('eob')} FROM l ORDER BY l.eob")
def bar_range(spark: SparkSession, folder: str) -> DataFrame:
    return Q.bar_range(official(spark, folder), "U5", FIRST, END, 60).select("symbol", "close_ticks", text("eob")["eob"].alias("eob"))


@query("latest_bars", f"{OFFICIAL}, u AS (SELECT symbol, eob, close_ticks, true AS official FROM o WHERE official_confirmed UNION ALL SELECT symbol, eob, close_ticks + 1, false FROM o) SELECT symbol, {stamp('eob')}, close_ticks, official FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY u.eob DESC, official DESC) = 1")
def latest_bars(spark: SparkSession, folder: str) -> DataFrame:
    rows = official(spark, folder)
    return Q.latest_bar(rows.filter("official_confirmed"), rows.withColumn("close_ticks", F.col("close_ticks") + 1)).select("symbol", text("eob")["eob"].alias("eob"), "close_ticks", "official")


@query("replay_universe", f"{UNIVERSE} SELECT symbol, coalesce(CASE WHEN max(s_suppkey) % 2 = 0 THEN 'Own ' || symbol END, arg_max(name, trading_date)) AS name FROM uni WHERE is_eligible AND trading_date BETWEEN DATE '{FIRST}' AND DATE '{END}' GROUP BY symbol ORDER BY symbol LIMIT 300")
def replay_universe(spark: SparkSession, folder: str) -> DataFrame:
    """A symbol whose largest supplier among its eligible rows of the range is even has a name of its own."""
    u = universe(spark, folder)
    own = u.filter(F.col("is_eligible") & F.col("trading_date").between(FIRST, END)).groupBy("symbol").agg(F.max("s_suppkey").alias("k"))
    named = own.filter("k % 2 = 0").select("symbol", F.concat(F.lit("Own "), "symbol").alias("name"))
    return Q.replay_universe(u, named, FIRST, END, limit=300, tie="s_suppkey")


@query("listed_instruments", "SELECT s_suppkey FROM supplier WHERE DATE '2000-01-01' + CAST(s_suppkey % 9000 AS INTEGER) <= DATE '2010-06-30' AND (s_suppkey % 3 = 0 OR DATE '2000-01-01' + CAST(s_suppkey % 9000 AS INTEGER) + 1000 >= DATE '2010-06-30')")
def listed_instruments(spark: SparkSession, folder: str) -> DataFrame:
    """Each third instrument has no end."""
    start = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("s_suppkey") % 9000).cast("int"))
    rows = A.table(spark, folder, "supplier").select("s_suppkey", start.alias("list_date"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(U.NO_END).cast("date")).otherwise(F.date_add(start, 1000)).alias("delist_date"))
    return U.listed_on(rows, F.lit("2010-06-30").cast("date")).select("s_suppkey")


@query("universe_gate", f"{UNIVERSE}, s AS (SELECT trading_date, count(*) AS total, count(*) FILTER (is_eligible) AS eligible, count(*) - count(DISTINCT symbol) AS duplicates, count(*) FILTER (s_suppkey % 50 = day(trading_date)) * 2 AS differing FROM uni GROUP BY ALL) SELECT strftime(trading_date, '%Y-%m-%d') AS trading_date, total, eligible, duplicates, differing, total BETWEEN 50 AND 500 AND eligible >= 20 AND duplicates = 0 AND differing = 0 AND day(s.trading_date) % 7 <> 3 AS passed FROM s")
def universe_gate(spark: SparkSession, folder: str) -> DataFrame:
    """A second snapshot that renames some rows, and a calendar that lacks some days."""
    u = universe(spark, folder)
    d = F.dayofmonth("trading_date")
    other = u.withColumn("name", F.when(F.col("s_suppkey") % 50 == d, "renamed").otherwise(F.col("name")))
    days = u.select("trading_date").distinct()
    return U.gate(u, other, days, days.filter(d % 7 != 3), bounds=(50, 500), least_eligible=20).withColumn("trading_date", day())


@query(
    "sparse_proofs",
    f"""WITH {TICKS}, {bars_sql('60m', 'b')}, r AS (SELECT symbol, slot, unnest([1, 2, 3]) AS read_id, close_ticks, volume, trading_date FROM b), c AS (SELECT symbol, slot, bool_or(slot = 3 AND read_id = 2) AS odd, count(DISTINCT read_id) AS reads FROM r GROUP BY ALL)
SELECT symbol, slot, reads, CASE WHEN odd THEN 2 ELSE 1 END AS answers, NOT odd AS proven FROM c""",
)
def sparse_proofs(spark: SparkSession, folder: str) -> DataFrame:
    """Three reads of all days' bars of a slot, one of which sees other volumes in slot 3."""
    bars = B.ticks_to_bars(A.ticks(spark, folder), "60m")
    reads = bars.withColumn("read_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("volume", F.when((F.col("slot") == 3) & (F.col("read_id") == 2), F.col("volume") + 1).otherwise(F.col("volume")))
    return U.sparse_proof(reads, ["symbol", "slot"], ["trading_date", "close_ticks", "volume"])


SLOTS30 = f"""WITH {TICKS}, {bars_sql('30m', 'b')}, d AS (SELECT DISTINCT symbol, trading_date FROM ticks), x AS (SELECT symbol, trading_date, unnest(range(8))::INTEGER AS slot FROM d),
y AS (SELECT x.*, b.slot IS NOT NULL AS have, coalesce(b.volume, 0) AS v, CAST(x.trading_date AS TIMESTAMP) + to_minutes(CASE WHEN (x.slot + 1) * 30 <= 120 THEN (x.slot + 1) * 30 + 570 ELSE (x.slot + 1) * 30 + 660 END) AS ends FROM x LEFT JOIN b USING (symbol, trading_date, slot))"""


@query(
    "gap_classes",
    f"""{SLOTS30}, z AS (SELECT *, CASE WHEN NOT have AND slot % 3 = 0 THEN 'verified_no_bar' WHEN have AND v % 6 = 0 THEN 'source_mismatch' WHEN have AND v % 5 = 0 THEN 'stale_unconfirmed' WHEN have THEN NULL WHEN date_diff('day', CAST(ends AS DATE), DATE '2024-03-10') > 60 THEN 'source_expired'
 WHEN CAST(ends AS DATE) = DATE '2024-01-30' AND slot = 7 THEN 'source_delayed' WHEN max(CASE WHEN have THEN slot END) OVER (PARTITION BY symbol, trading_date) > slot THEN 'sequence_gap' ELSE 'missing_slot' END AS gap_class FROM y)
SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, gap_class FROM z WHERE gap_class IS NOT NULL""",
)
def gap_classes(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    slot = ["symbol", "trading_date", "slot"]
    bars = B.with_row_hash(B.ticks_to_bars(ticks, "30m")).select(*slot, F.col("row_hash").alias("local_hash"), "volume")
    rows = B.expected_slots(ticks.select("symbol", "trading_date").distinct(), "30m").join(bars, slot, "left")
    have, v = F.col("local_hash").isNotNull(), F.coalesce("volume", F.lit(0))
    from pyspark.sql import Window

    last = F.max(F.when(have, F.col("slot"))).over(Window.partitionBy("symbol", "trading_date"))
    rows = rows.withColumns(
        {"frequency": F.lit("30m"), "end": slot_end(F.col("trading_date"), F.col("slot"), "30m"), "official_hash": F.when(have & (v % 6 == 0), "other").when(have, F.col("local_hash")), "confirmed": v % 5 != 0, "proven": ~have & (F.col("slot") % 3 == 0), "later": F.coalesce(last > F.col("slot"), F.lit(False))}
    )
    # the last slot of the last day has only just ended
    late = (F.to_date("end") == F.lit("2024-01-30").cast("date")) & (F.col("slot") == 7)
    now = F.when(late, F.timestamp_add("SECOND", F.lit(30), F.col("end"))).otherwise(F.lit("2024-03-10 00:00:00").cast("timestamp_ntz"))
    return R.classify_gaps(rows, now).filter("gap_class is not null").select("symbol", day(), "slot", "gap_class")


@query(
    "retractions",
    f"""{SLOTS30}, bars AS (SELECT symbol, trading_date, slot, CAST(slot % 3 AS INTEGER) AS at FROM y WHERE have), gone AS (SELECT symbol, trading_date, slot, CAST((slot + day(trading_date)) % 3 AS INTEGER) AS at FROM y)
SELECT 'bars' AS kind, strftime(trading_date, '%Y-%m-%d') AS trading_date, count(*) AS n FROM (SELECT b.trading_date FROM bars b JOIN gone g USING (symbol, trading_date, slot) WHERE g.at <= b.at) GROUP BY trading_date
UNION ALL SELECT 'missing', strftime(trading_date, '%Y-%m-%d'), count(*) FROM (SELECT g.trading_date FROM gone g LEFT JOIN bars b USING (symbol, trading_date, slot) WHERE b.at IS NULL OR b.at < g.at) GROUP BY trading_date""",
)
def retractions(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    slots = B.expected_slots(ticks.select("symbol", "trading_date").distinct(), "30m").withColumns({"frequency": F.lit("30m"), "read_at": ((F.col("slot") + F.dayofmonth("trading_date")) % 3).cast("int")})
    bars = B.ticks_to_bars(ticks, "30m").withColumn("read_at", (F.col("slot") % 3).cast("int"))
    left, missing = R.apply_retractions(bars, slots)
    count = lambda rows, kind: rows.groupBy("trading_date").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), day(), "n")
    return count(left, "bars").unionByName(count(missing, "missing"))


@query(
    "affected_ranges",
    f"""WITH {TICKS}, {bars_sql('30m', 'b')}, o AS (SELECT DISTINCT symbol, date_diff('day', DATE '2024-01-01', trading_date) * 8 + slot AS k FROM b WHERE volume % 9 = 0), r AS (SELECT *, greatest(k - 3, 0) AS f, lag(k) OVER (PARTITION BY symbol ORDER BY k) AS p FROM o),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR f > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT symbol, '30m' AS frequency, min(k) AS earliest, max(k) AS latest, min(f) AS from_ordinal, count(*) AS changed, CAST(floor(min(f) / 8) AS BIGINT) AS from_day FROM g GROUP BY symbol, run""",
)
def affected_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Changed 30-minute slots, with three slots of look-back."""
    rows = B.ticks_to_bars(A.ticks(spark, folder), "30m").filter("volume % 9 = 0")
    return R.affected_ranges(rows.withColumn("ordinal", F.datediff("trading_date", F.lit("2024-01-01").cast("date")) * 8 + F.col("slot")), {"30m": 3}, {"30m": 8})


_EVENT_COLUMNS = ["event_key", "symbol", "side", "ticks", "generation", "stage", "hits_5m", "total_hit_count"]


@query("recomputed_events", f"{EVENTS} SELECT {', '.join(_EVENT_COLUMNS)}, {stamp('observed_at')}, {stamp('break_eob')} FROM ev")
def recomputed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all ticks, reached from those without the late ones by computing only the affected days anew: every fortieth tick after
    a date is late."""
    ticks = A.ticks(spark, folder)
    early = store.staged(B.ticks_to_bars(ticks.filter(f"event_id % 40 <> 7 OR event_time < TIMESTAMP_NTZ '{END} 00:00:00'"), "5m"), "early-bars")
    all_bars = intraday(spark, folder)
    held = store.staged(P.replay(frames(early)), "held-events")
    hits = P.evidence(held, P.with_breaks(P.pair_hits(early), early))
    changed = R.changed_slots(B.with_row_hash(early), B.with_row_hash(all_bars["5m"]))
    days = R.affected_days(changed, all_bars["5m"].select("trading_date"), {"5m": 1}, {"5m": 48})
    out, _ = R.recompute(held, hits, all_bars, store.staged(days, "affected-days"))
    return out.select(*_EVENT_COLUMNS, *[c.alias(n) for n, c in text("observed_at", "break_eob").items()])


@query("run_summary", f"{HITS}, s AS (SELECT symbol, CASE WHEN symbol IN (SELECT symbol FROM b5m) THEN 'complete' ELSE 'failed' END AS status FROM (SELECT DISTINCT 'U' || CAST(user_id % 24 AS VARCHAR) AS symbol FROM events)) SELECT count(*) FILTER (status = 'complete') AS completed_symbols, count(*) FILTER (status = 'failed') AS failed_symbols, (SELECT count(*) FROM b5m JOIN s USING (symbol) WHERE status = 'complete') AS bars, (SELECT count(*) FROM evidence JOIN s USING (symbol) WHERE status = 'complete') AS hits, (SELECT count(*) FROM ev JOIN s USING (symbol) WHERE s.status = 'complete') AS events, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'complete' END AS run_status FROM s")
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Over a universe of which some symbols do not tick."""
    e, hits, _ = replayed(spark, folder)
    universe = A.table(spark, folder, "events").select(F.concat(F.lit("U"), (F.col("user_id") % 24).cast("string")).alias("symbol")).distinct()
    own = lambda rows: rows.join(universe, "symbol", "left_semi")
    return R.run_summary(R.symbol_results(universe, own(intraday(spark, folder)["5m"]), own(hits), own(e)))


@query("ingest_progress", "SELECT c_custkey, count(o_orderkey) AS children, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, coalesce(sum(o_orderkey % 4), 0)::BIGINT AS attempts FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ingest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Batches and their partitions: customers and their orders."""
    parts = A.table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 4).alias("attempts"))
    return R.status_rollup(A.table(spark, folder, "customer").select("c_custkey"), parts, "c_custkey", ["F", "O", "P"])


@query("alerts", f"{HITS} SELECT sha256(event_key || '|' || to_stage || '|' || strftime(moment, '%Y-%m-%d %H:%M:%S')) AS outbox_id, event_key, to_stage, CASE to_stage WHEN 'ESTABLISHED' THEN 'critical' WHEN 'OBSERVING' THEN 'info' ELSE 'warning' END AS severity, concat_ws(' ', symbol, side, CASE to_stage WHEN 'FOCUS' THEN 'Focus' ELSE upper(to_stage[1]) || lower(to_stage[2:]) END) AS title, CASE WHEN to_stage = 'INVALIDATED' THEN 'NONE' WHEN side = 'TOP' THEN 'SELL' ELSE 'BUY' END AS reminder FROM moves WHERE notify")
def alerts(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return C.alerts(P.lifecycle(e), e).select("outbox_id", "event_key", "to_stage", "severity", "title", "reminder")


@query("notify_eligible", f"{HITS}, t AS (SELECT event_key, to_stage, date_diff('second', moment, TIMESTAMP '2024-01-15 11:00:00') AS age, to_stage = 'ESTABLISHED' AS daily FROM moves) SELECT event_key, to_stage, age >= -120 AND age <= CASE WHEN daily THEN 7200 ELSE 3600 END AS eligible FROM t")
def notify_eligible(spark: SparkSession, folder: str) -> DataFrame:
    moves = P.lifecycle(events(spark, folder)).withColumn("frequency", F.when(F.col("to_stage") == "ESTABLISHED", "1d").otherwise("5m"))
    return C.with_notify(moves, F.lit("2024-01-15 11:00:00").cast("timestamp_ntz")).select("event_key", "to_stage", "eligible")


@query(
    "card_updates",
    f"""{HITS}, n AS (SELECT event_key, arg_max(to_stage, (moment, to_stage)) AS state, max(moment) AS moment, count(*) AS k FROM moves GROUP BY event_key), o AS (SELECT event_key, discovered_at AS moment FROM ev WHERE ticks % 2 = 0)
SELECT n.event_key AS task_key, CASE WHEN o.event_key IS NOT NULL AND k = 1 THEN 'DISCOVERED' ELSE state END AS state, CASE WHEN o.event_key IS NULL THEN 0 WHEN k = 1 THEN 4 ELSE 5 END AS revision, o.event_key IS NULL OR k > 1 AS changed FROM n LEFT JOIN o USING (event_key)""",
)
def card_updates(spark: SparkSession, folder: str) -> DataFrame:
    """The newest transition of each event over cards that half of the events have as discovered."""
    e = events(spark, folder)
    event_id = F.concat_ws("|", "task_key", "state").alias("event_id")
    held = e.filter("ticks % 2 = 0").select(F.col("event_key").alias("task_key"), F.lit("DISCOVERED").alias("state"), F.col("discovered_at").alias("at"), F.lit(4).alias("revision"))
    new = P.lifecycle(e).select(F.col("event_key").alias("task_key"), F.col("to_stage").alias("state"), "at")
    cards, changes = C.upsert_cards(held.select("task_key", "state", "at", event_id, "revision"), new.select("task_key", "state", "at", event_id))
    changed = changes.select("task_key", F.lit(True).alias("changed"))
    return cards.join(changed, "task_key", "left").select("task_key", "state", "revision", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("wave_jobs", f"{EVENTS}, f AS (SELECT * FROM ev WHERE side = 'BOTTOM' AND focused_at IS NOT NULL AND ((is_active AND stage IN ('FOCUS', 'ESTABLISHED')) OR ticks % 2 = 0) AND ticks % 7 <> 0) SELECT event_key, symbol, strftime(CAST(focused_at AS DATE) - 1, '%Y-%m-%d') AS data_end FROM f")
def wave_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The version before has scored every second event, this one every seventh."""
    e = events(spark, folder)
    done = lambda n, version: e.filter(F.col("ticks") % n == 0).select("event_key", "focused_at", F.lit(version).alias("version"), F.lit("COMPLETED").alias("status"))
    return C.wave_jobs(e, done(2, "v2").unionByName(done(7, "v3"))).select("event_key", "symbol", day("data_end"))


@query("pool_assignments", f"WITH {TICKS} SELECT symbol, CASE WHEN CAST(substr(symbol, 2) AS INTEGER) % 4 < 3 THEN 'w' || CAST(CAST(substr(symbol, 2) AS INTEGER) % 4 AS VARCHAR) END AS worker FROM (SELECT DISTINCT symbol FROM ticks)")
def pool_assignments(spark: SparkSession, folder: str) -> DataFrame:
    symbols = A.ticks(spark, folder).select("symbol").distinct()
    k = F.substring("symbol", 2, 9).cast("int") % 4
    dealt = symbols.filter(k < 3).groupBy(F.concat(F.lit("w"), k.cast("string")).alias("worker")).agg(F.collect_list("symbol").alias("symbols"))
    return C.with_assignment(symbols, dealt)


_CARDS = f"""{ROLLED}, nw AS (SELECT symbol, trading_date, strategy_code, arg_max(signal_id, (observed_at, signal_id)) AS signal_id, arg_max(score, (observed_at, signal_id)) AS signal_score, count(*) AS n FROM sig GROUP BY ALL)"""


@query("opportunity_cards", f"{_CARDS} SELECT nw.symbol, strftime(nw.trading_date, '%Y-%m-%d') AS trading_date, nw.strategy_code, opp.level, nw.signal_id, signal_score, CASE WHEN nw.symbol LIKE '%1' THEN 'Name ' || nw.symbol ELSE nw.symbol END AS name, lower(nw.strategy_code) AS title FROM opp JOIN nw USING (symbol, trading_date)")
def opportunity_cards(spark: SparkSession, folder: str) -> DataFrame:
    signals = A.signals(spark, folder)
    detail = signals.select("symbol", "trading_date", "strategy_code").distinct()
    names = signals.select("symbol").distinct().filter("symbol like '%1'").withColumn("name", F.concat(F.lit("Name "), "symbol"))
    titles = signals.select("strategy_code").distinct().withColumn("title", F.lower("strategy_code"))
    rows = C.opportunity_cards(S.opportunities(signals).select("symbol", "trading_date", "level"), detail, names, titles, signals)
    return rows.select("symbol", day(), "strategy_code", "level", "signal_id", "signal_score", "name", "title")


@query(
    "initial_cards",
    f"""{ROLLED.replace('WITH ', HITS + ', ', 1)}, nd AS (SELECT max(trading_date) AS d FROM opp), a AS (SELECT 'opportunity|' || symbol || '|' || strftime(trading_date, '%Y-%m-%d') AS task_key, symbol, 'opportunity' AS kind, level AS state, CASE level WHEN 'focus' THEN 'critical' WHEN 'candidate' THEN 'warning' ELSE 'info' END AS severity FROM opp, nd WHERE trading_date = d),
b AS (SELECT 'event|' || event_key AS task_key, symbol, 'event' AS kind, to_stage AS state, CASE to_stage WHEN 'ESTABLISHED' THEN 'critical' WHEN 'OBSERVING' THEN 'info' ELSE 'warning' END AS severity FROM moves WHERE notify AND moment >= TIMESTAMP '2024-01-10 00:00:00' QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY moment DESC, to_stage DESC) = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""",
)
def initial_cards(spark: SparkSession, folder: str) -> DataFrame:
    moves = P.lifecycle(events(spark, folder))
    return C.initial_cards(S.opportunities(A.signals(spark, folder)), moves, F.lit("2024-02-09").cast("date")).drop("at")


@query(
    "signal_revisions",
    f"""WITH {SIGNALS}, a AS (SELECT *, CASE WHEN score >= 90 THEN 2 WHEN score % 2 = 0 THEN 1 ELSE 0 END AS rank, signal_id % 3 AS mark, o_seconds FROM (SELECT *, epoch(observed_at)::BIGINT AS o_seconds FROM sig)),
l AS (SELECT *, lag(score) OVER w AS ps, lag(rank) OVER w AS pr, lag(mark) OVER w AS pm, lag(o_seconds) OVER w AS po FROM a WINDOW w AS (PARTITION BY symbol, strategy_code, trading_date ORDER BY observed_at, signal_id))
SELECT signal_id, CASE WHEN ps IS NULL THEN 'New' WHEN mark <> pm AND o_seconds - po <= 600 THEN 'Revised' WHEN score >= ps + 2 OR rank > pr THEN 'Strengthened' ELSE 'Repeated' END AS event_type FROM l""",
)
def signal_revisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.signals(spark, folder).withColumns({"action": F.when(F.col("score") >= 90, "CONFIRM").when(F.col("score") % 2 == 0, "CANDIDATE").otherwise("NONE"), "watermark": F.col("signal_id") % 3})
    return S.classify_signals(rows, within=600).select("signal_id", "event_type")


@query("signal_expiries", f"WITH {SIGNALS}, q AS (SELECT *, date_diff('second', observed_at, CAST(trading_date AS TIMESTAMP) + INTERVAL 4 HOUR) // 60 AS minutes FROM sig), a AS (SELECT *, CASE WHEN minutes >= 18 THEN 'expired' WHEN minutes >= 6 THEN 'weakened' ELSE status END AS aged FROM q) SELECT status AS from_status, aged AS to_status, count(*) AS n FROM a WHERE aged <> status GROUP BY ALL")
def signal_expiries(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.signals(spark, folder).withColumn("last_seen_at", F.col("observed_at"))
    aged = S.age(rows, F.timestamp_add("HOUR", F.lit(4), F.col("trading_date").cast("timestamp_ntz")))
    return S.expiries(aged).groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


@query("signal_filter", f"WITH {SIGNALS} SELECT signal_id, score FROM sig WHERE symbol = 'C7' AND strategy_code = '1-URGENT'")
def signal_filter(spark: SparkSession, folder: str) -> DataFrame:
    return S.filter_signals(A.signals(spark, folder), symbol="C7", strategy="1-URGENT").select("signal_id", "score")


@query("active_opportunities", f"{ROLLED} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, best_score FROM opp WHERE level = 'focus' AND status = 'active'")
def active_opportunities(spark: SparkSession, folder: str) -> DataFrame:
    return S.filter_opportunities(S.opportunities(A.signals(spark, folder)), level="focus").select("symbol", day(), "best_score")


@query("signal_outcomes", f"{BASE}, {AHEAD}, s AS (SELECT symbol, trading_date, c % 40 + 60 AS score FROM outcome WHERE c % 2 = 0 UNION ALL SELECT symbol, trading_date + 1, 0 FROM outcome WHERE c % 9 = 0) SELECT s.symbol, strftime(s.trading_date, '%Y-%m-%d') AS trading_date, score, round(d1, 4) AS d1, round(w1, 4) AS w1 FROM s LEFT JOIN outcome USING (symbol, trading_date)")
def signal_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Signals on bars and on days that may have none."""
    bars = A.daily_bars(spark, folder)
    c = F.col("close_ticks")
    signals = bars.filter(c % 2 == 0).select("symbol", "trading_date", (c % 40 + 60).alias("score")).unionByName(bars.filter(c % 9 == 0).select("symbol", F.date_add("trading_date", 1).alias("trading_date"), F.lit(0).cast("long").alias("score")))
    outcomes = D.forward_outcomes(bars.select("symbol", "trading_date"), bars)
    return rounded(S.with_outcome(signals, outcomes), "d1", "w1").select("symbol", day(), "score", "d1", "w1")


@query(
    "seeded_state",
    f"""{HITS} SELECT 'events' AS dataset, count(*) AS n FROM ev WHERE is_active UNION ALL SELECT 'hits', count(*) FROM evidence JOIN ev USING (event_key) WHERE is_active UNION ALL SELECT 'lifecycle', count(*) FROM moves JOIN ev USING (event_key) WHERE is_active""",
)
def seeded_state(spark: SparkSession, folder: str) -> DataFrame:
    state = store.seed_live(*replayed(spark, folder))
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("dataset"), "n") for k, d in state.items()])


@query("scope_counts", f"WITH {TICKS} SELECT count(DISTINCT trading_date) AS dates, count(DISTINCT symbol) AS symbols FROM ticks")
def scope_counts(spark: SparkSession, folder: str) -> DataFrame:
    return A.ticks(spark, folder).agg(F.count_distinct("trading_date").alias("dates"), F.count_distinct("symbol").alias("symbols"))


@query(
    "broken_levels",
    f"""{EVENTS}, l AS (SELECT event_key, symbol, side, ticks AS level, discovered_at FROM ev WHERE promotions > 0), k AS (SELECT l.*, t.event_time, t.price_ticks, t.event_id FROM l JOIN ticks t ON t.symbol = l.symbol AND t.event_time > discovered_at AND ((side = 'TOP' AND t.price_ticks > level) OR (side = 'BOTTOM' AND t.price_ticks < level)))
SELECT event_key, {stamp('event_time')}, price_ticks FROM k QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY k.event_time, event_id) = 1""",
)
def broken_levels(spark: SparkSession, folder: str) -> DataFrame:
    from tidebar.streaming.ticks import first_breaks

    levels = events(spark, folder).filter("promotions > 0").select("event_key", "symbol", "side", "ticks", F.col("discovered_at").alias("first_seen_at"))
    return first_breaks(A.ticks(spark, folder), levels).select("event_key", text("event_time")["event_time"].alias("event_time"), "price_ticks")


def daily_job(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The day's pipeline: universe, bars, roll-up, quality, events and their validation."""
    bars = intraday(spark, folder)
    days = A.ticks(spark, folder).select("symbol", "trading_date").distinct()
    ok, bad = B.split_valid(bars["5m"])
    e, hits, moves = replayed(spark, folder)
    return {
        "universe": universe(spark, folder), "bars_5m": ok, "rejected": bad, **{f"bars_{f}": bars[f] for f in ("30m", "60m", "1d")}, "issues": B.quality_issues(bars["30m"], days, "30m"), "events": e, "hits": hits, "lifecycle": moves,
    }


@query(
    "daily_job",
    f"""{HITS}, r AS (SELECT symbol, trading_date, floor(slot / 6) AS s, count(*) AS n FROM b5m GROUP BY ALL)
SELECT 'universe' AS dataset, (SELECT count(*) FROM supplier) * (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS n UNION ALL SELECT 'bars_5m', count(*) FROM b5m UNION ALL SELECT 'rejected', 0 UNION ALL SELECT 'bars_30m', count(*) FROM b30m UNION ALL SELECT 'bars_60m', count(*) FROM b60m UNION ALL SELECT 'bars_1d', count(*) FROM b1d
UNION ALL SELECT 'issues', (SELECT count(*) FROM (SELECT symbol, trading_date FROM r WHERE n < 6 GROUP BY ALL)) + (SELECT count(*) FROM (SELECT symbol, trading_date FROM r GROUP BY ALL HAVING count(*) < 8)) UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'hits', count(*) FROM evidence UNION ALL SELECT 'lifecycle', count(*) FROM moves""",
)
def daily_job_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("dataset"), "n") for k, d in daily_job(spark, folder).items()])
