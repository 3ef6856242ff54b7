"""Registered market-data queries, each with its SQL.

Times leave as text, prices as whole hundredths, so that two engines agree to the byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.session import MINUTES
from tidebar.operators import bars as B
from tidebar.operators import pairs as P
from tidebar.sources import adapters as A
from tidebar.sources import store as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUTOFF = "2024-01-20 00:00:00"
DAY_FROM, DAY_TO = "1996-01-01", "2000-12-31"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def text(*names: str) -> dict[str, Column]:
    return {n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names}


def day(name: str = "trading_date") -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


TICKS = """ticks AS (
  SELECT 'U' || CAST(user_id % 20 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS trading_date, m AS minute,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_minutes(CASE WHEN m < 120 THEN m + 570 ELSE m + 660 END) + to_seconds(CAST(second(ts) AS INTEGER)) AS event_time,
         CAST(round(value * 100) AS BIGINT) AS price_ticks, CAST(json_extract(props, '$.k') AS BIGINT) AS volume, event_id, user_id AS worker_id
  FROM (SELECT *, CAST(floor((hour(ts) * 60 + minute(ts)) / 6) AS INTEGER) AS m FROM events WHERE value > 0))"""


def bars_sql(frequency: str, name: str) -> str:
    n = MINUTES[frequency]
    return f"""{name} AS (
  SELECT symbol, trading_date, CAST(floor(minute / {n}) AS INTEGER) AS slot, '{frequency}' AS frequency,
         arg_min(price_ticks, (event_time, event_id)) AS open_ticks, max(price_ticks) AS high_ticks, min(price_ticks) AS low_ticks, arg_max(price_ticks, (event_time, event_id)) AS close_ticks,
         sum(volume)::BIGINT AS volume, sum(price_ticks * volume)::BIGINT AS amount_ticks, count(*) AS tick_count,
         CAST(trading_date AS TIMESTAMP) + to_minutes(CASE WHEN e <= 120 THEN e + 570 ELSE e + 660 END) AS eob
  FROM (SELECT *, CAST((floor(minute / {n}) + 1) * {n} AS INTEGER) AS e FROM ticks) GROUP BY symbol, trading_date, slot, e)"""


def hits_sql(bars: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN ticks % 100 = 0 THEN 'ROUND_00' ELSE 'DOUBLE_DIGIT' END AS pair_kind, CAST(ticks % 100 AS INTEGER) AS pair_code FROM (
    SELECT symbol, trading_date, frequency, eob, 'TOP' AS side, high_ticks AS ticks FROM {bars} UNION ALL SELECT symbol, trading_date, frequency, eob, 'BOTTOM', low_ticks FROM {bars})
  WHERE ticks > 0 AND (ticks % 100) % 11 = 0)"""


def stamp(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


BARS = "WITH " + ",\n".join([TICKS, *[bars_sql(f, f"b{f}") for f in ("5m", "30m", "60m", "1d")]])
EVENTS = BARS + ",\n" + ",\n".join(
    [
        *[hits_sql(f"b{f}", f"h{f}") for f in ("5m", "30m", "60m", "1d")],
        """broken AS (
  SELECT h.*, (SELECT min(b.eob) FROM b5m b WHERE b.symbol = h.symbol AND b.eob > h.eob
               AND ((h.side = 'TOP' AND b.high_ticks > h.ticks) OR (h.side = 'BOTTOM' AND b.low_ticks < h.ticks))) AS break_eob FROM h5m h)""",
        """roots AS (
  SELECT g.*, CASE WHEN side = 'TOP' THEN b.high_ticks ELSE b.low_ticks END AS break_ticks, row_number() OVER (PARTITION BY g.symbol, side, ticks ORDER BY discovered_at) AS generation,
         sha256(g.symbol || '|' || side || '|' || CAST(ticks AS VARCHAR) || '|' || strftime(discovered_at, '%Y-%m-%d %H:%M:%S')) AS event_key
  FROM (SELECT symbol, side, ticks, pair_kind, pair_code, break_eob, min(eob) AS discovered_at, max(eob) AS last_hit_at, count(DISTINCT eob) AS hits_5m FROM broken GROUP BY ALL) g
  LEFT JOIN b5m b ON b.symbol = g.symbol AND b.eob = g.break_eob)""",
        """p1 AS (SELECT r.*, (SELECT min(h.eob) FROM h30m h WHERE h.symbol = r.symbol AND h.side = r.side AND h.ticks = r.ticks AND h.eob >= r.discovered_at AND (r.break_eob IS NULL OR h.eob < r.break_eob)) AS observed_at FROM roots r)""",
        """p2 AS (SELECT r.*, (SELECT min(h.eob) FROM h60m h WHERE h.symbol = r.symbol AND h.side = r.side AND h.ticks = r.ticks AND h.eob >= r.observed_at AND (r.break_eob IS NULL OR h.eob < r.break_eob)) AS focused_at FROM p1 r)""",
        """p3 AS (SELECT r.*, (SELECT min(h.eob) FROM h1d h WHERE h.symbol = r.symbol AND h.side = r.side AND h.ticks = r.ticks AND h.eob >= r.focused_at AND (r.break_eob IS NULL OR h.eob < r.break_eob)) AS established_at FROM p2 r)""",
        """ev AS (
  SELECT *, CASE promotions WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'OBSERVING' WHEN 2 THEN 'FOCUS' ELSE 'ESTABLISHED' END AS strongest_stage,
         CASE WHEN break_eob IS NOT NULL THEN 'INVALIDATED' WHEN promotions = 0 THEN 'DISCOVERED' WHEN promotions = 1 THEN 'OBSERVING' WHEN promotions = 2 THEN 'FOCUS' ELSE 'ESTABLISHED' END AS stage,
         CASE WHEN break_eob IS NOT NULL THEN 'INVALIDATED' WHEN promotions = 0 THEN 'CANDIDATE' ELSE 'CONFIRMED' END AS status,
         CAST((promotions + 1) / 4.0 AS DOUBLE) AS score, CAST([1, 3, 7, 15][promotions + 1] AS INTEGER) AS timeframe_mask, ['5m', '30m', '60m', '1d'][promotions + 1] AS strongest_frequency,
         ['5m', '5m,30m', '5m,30m,60m', '5m,30m,60m,1d'][promotions + 1] AS frequencies, promotions + 1 AS confluence, hits_5m + promotions AS total_hit_count, greatest(last_hit_at, observed_at, focused_at, established_at, break_eob) AS last_seen_at, break_eob IS NULL AS is_active
  FROM (SELECT *, (observed_at IS NOT NULL)::INTEGER + (focused_at IS NOT NULL)::INTEGER + (established_at IS NOT NULL)::INTEGER AS promotions FROM p3))""",
    ]
)


def intraday(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All frequencies from one pass over the ticks: the longer bars are rolled up from the 5-minute ones, which are stored as what reads
    them does so many times."""
    return frames(S.staged(B.ticks_to_bars(A.ticks(spark, folder), "5m"), "bars-5m"))


def frames(five: DataFrame) -> dict[str, DataFrame]:
    return {"5m": five} | {f: B.roll_up(five, f) for f in ("30m", "60m", "1d")}


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The replay's events as a stored table: written by the first query that asks for it, and anew if the ticks' files change."""
    return S.kept(spark, "pair-events", [f"{folder}/events.parquet"], lambda: P.replay(intraday(spark, folder)))


def replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, hits, lifecycle)."""
    five = intraday(spark, folder)["5m"]
    e = events(spark, folder)
    return e, P.evidence(e, P.with_breaks(P.pair_hits(five), five)), P.lifecycle(e)


def _bar_query(frequency: str) -> None:
    columns = ["symbol", "slot", *B.FACTS, "tick_count"]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = B.ticks_to_bars(A.ticks(spark, folder), frequency)
        return rows.select(*columns, day(), *[c.alias(n) for n, c in text("eob").items()])

    QUERIES[f"bars_{frequency}"] = run
    SQL[f"bars_{frequency}"] = f"WITH {TICKS}, {bars_sql(frequency, 'b')} SELECT {', '.join(columns)}, strftime(trading_date, '%Y-%m-%d') AS trading_date, {stamp('eob')} FROM b"


for _f in MINUTES:
    _bar_query(_f)


@query("pair_hits_5m", f"{BARS}, {hits_sql('b5m', 'h')} SELECT symbol, frequency, side, ticks, pair_kind, pair_code, {stamp('eob')} FROM h")
def pair_hits_5m(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.pair_hits(B.ticks_to_bars(A.ticks(spark, folder), "5m"))
    return rows.select("symbol", "frequency", "side", "ticks", "pair_kind", "pair_code", text("eob")["eob"].alias("eob"))


_TIMES = ["discovered_at", "observed_at", "focused_at", "established_at", "break_eob", "last_seen_at"]
_FACTS = ["event_key", "symbol", "side", "ticks", "pair_kind", "pair_code", "generation", "break_ticks", "stage", "strongest_stage", "status", "score", "timeframe_mask", "strongest_frequency", "hits_5m", "total_hit_count", "is_active"]


@query("pair_events", f"{EVENTS} SELECT {', '.join(_FACTS)}, {', '.join(map(stamp, _TIMES))} FROM ev")
def pair_events(spark: SparkSession, folder: str) -> DataFrame:
    """The replay itself, from ticks; other queries read the events that it stores."""
    return P.replay(intraday(spark, folder)).select(*_FACTS, *[c.alias(n) for n, c in text(*_TIMES).items()])


@query(
    "pair_lifecycle",
    f"""{EVENTS}, l AS (
  SELECT event_key, symbol, 'DISCOVERED' AS to_stage, discovered_at AS moment, 'FIVE_MINUTE_DISCOVERY' AS reason, false AS notify FROM ev
  UNION ALL SELECT event_key, symbol, 'OBSERVING', observed_at, 'SAME_PRICE_30M', true FROM ev WHERE observed_at IS NOT NULL
  UNION ALL SELECT event_key, symbol, 'FOCUS', focused_at, 'SAME_PRICE_60M', true FROM ev WHERE focused_at IS NOT NULL
  UNION ALL SELECT event_key, symbol, 'ESTABLISHED', established_at, 'SAME_PRICE_1D', true FROM ev WHERE established_at IS NOT NULL
  UNION ALL SELECT event_key, symbol, 'INVALIDATED', break_eob, CASE WHEN side = 'TOP' THEN 'HIGHER_PRICE_BREAK' ELSE 'LOWER_PRICE_BREAK' END, observed_at IS NOT NULL FROM ev WHERE break_eob IS NOT NULL)
SELECT event_key, symbol, to_stage, reason, notify, {stamp('moment', '"at"')} FROM l""",
)
def pair_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return P.lifecycle(events(spark, folder)).withColumns(text("at"))


_CUT = f"TIMESTAMP '{CUTOFF}'"
_STAGE_THEN = f"""CASE WHEN break_eob < {_CUT} THEN 'INVALIDATED' WHEN established_at < {_CUT} THEN 'ESTABLISHED' WHEN focused_at < {_CUT} THEN 'FOCUS' WHEN observed_at < {_CUT} THEN 'OBSERVING' ELSE 'DISCOVERED' END"""


def cutoff() -> Column:
    return F.lit(CUTOFF).cast("timestamp_ntz")


@query(
    "stock_groups",
    f"""{EVENTS}, t AS (SELECT *, {_STAGE_THEN} AS stage_then FROM ev)
SELECT symbol, {stamp('max(discovered_at)', 'latest_pivot_at')}, {stamp("max(discovered_at) FILTER (side = 'TOP')", 'latest_top_at')}, {stamp("max(discovered_at) FILTER (side = 'BOTTOM')", 'latest_bottom_at')},
       count(*) AS events, count(*) FILTER (side = 'TOP') AS tops, count(*) FILTER (side = 'BOTTOM') AS bottoms, count(*) FILTER (stage_then <> 'INVALIDATED') AS active,
       count(*) FILTER (stage_then = 'INVALIDATED') AS invalidated, arg_max(stage_then, (discovered_at, event_key)) AS latest_stage FROM t GROUP BY symbol""",
)
def stock_groups(spark: SparkSession, folder: str) -> DataFrame:
    return P.stock_groups(events(spark, folder), cutoff()).withColumns(text("latest_pivot_at", "latest_top_at", "latest_bottom_at"))


@query("stage_as_of", f"{EVENTS} SELECT event_key, {_STAGE_THEN} AS stage_then FROM ev")
def stage_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).select("event_key", P.stage_at(cutoff()).alias("stage_then"))


@query(
    "event_totals",
    f"""{EVENTS} SELECT count(*) AS events, sum(total_hit_count)::BIGINT AS hits, count(*) FILTER (status = 'CONFIRMED') AS confirmed, count(*) FILTER (status = 'INVALIDATED') AS invalidated,
 sum(CASE WHEN stage = 'DISCOVERED' THEN total_hit_count ELSE 0 END)::BIGINT AS pending, count(*) FILTER (pair_kind = 'ROUND_00') AS round_00, count(*) FILTER (pair_kind = 'DOUBLE_DIGIT') AS double_digit, count(DISTINCT symbol) AS symbols FROM ev""",
)
def event_totals(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).agg(
        F.count("*").alias("events"), F.sum("total_hit_count").alias("hits"), F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("status") == "INVALIDATED").alias("invalidated"),
        F.sum(F.when(F.col("stage") == "DISCOVERED", F.col("total_hit_count")).otherwise(0)).alias("pending"), F.count_if(F.col("pair_kind") == "ROUND_00").alias("round_00"),
        F.count_if(F.col("pair_kind") == "DOUBLE_DIGIT").alias("double_digit"), F.count_distinct("symbol").alias("symbols"),
    )


@query("event_breakdown", f"{EVENTS} SELECT side, status, pair_kind, count(*) AS n FROM ev GROUP BY GROUPING SETS ((side, status), (side, pair_kind))")
def event_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return e.groupingSets([["side", "status"], ["side", "pair_kind"]], "side", "status", "pair_kind").agg(F.count("*").alias("n"))


@query(
    "hits_by_frequency",
    f"{BARS}, {', '.join(hits_sql(f'b{f}', f'h{f}') for f in ('5m', '30m', '60m', '1d'))} SELECT frequency, pair_kind, count(*) AS n, count(DISTINCT symbol) AS symbols FROM "
    "(SELECT * FROM h5m UNION ALL SELECT * FROM h30m UNION ALL SELECT * FROM h60m UNION ALL SELECT * FROM h1d) GROUP BY ALL",
)
def hits_by_frequency(spark: SparkSession, folder: str) -> DataFrame:
    b = intraday(spark, folder)
    rows = P.pair_hits(b["5m"]).union(P.pair_hits(b["30m"])).union(P.pair_hits(b["60m"])).union(P.pair_hits(b["1d"]))
    return rows.groupBy("frequency", "pair_kind").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


@query("stage_table", f"{EVENTS} SELECT strongest_stage, count(*) AS events, count(DISTINCT symbol) AS symbols, count(*) FILTER (is_active) AS active FROM ev GROUP BY 1")
def stage_table(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).groupBy("strongest_stage").agg(F.count("*").alias("events"), F.count_distinct("symbol").alias("symbols"), F.count_if("is_active").alias("active"))


@query(
    "event_page",
    f"""{EVENTS}, x AS (SELECT * FROM ev WHERE side = 'BOTTOM' AND score >= 0.5), p AS (SELECT * FROM x ORDER BY total_hit_count DESC, event_key LIMIT 50 OFFSET 50)
SELECT event_key, symbol, score, total_hit_count, {stamp('discovered_at')}, (SELECT count(*) FROM x) AS total, CAST(ceil((SELECT count(*) FROM x) / 50.0) AS BIGINT) AS pages FROM p""",
)
def event_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = replayed(spark, folder)[0].filter("side = 'BOTTOM' and score >= 0.5")
    return P.event_list(rows, "hits", True, 2, 50).select("event_key", "symbol", "score", "total_hit_count", text("discovered_at")["discovered_at"].alias("discovered_at"), "total", "pages")


HITS = EVENTS + """,
evidence AS (SELECT e.event_key, e.symbol, e.side, e.ticks, e.pair_kind, '5m' AS frequency, 'DISCOVERED' AS stage, b.eob FROM ev e JOIN (SELECT DISTINCT symbol, side, ticks, break_eob, eob FROM broken) b
   ON b.symbol = e.symbol AND b.side = e.side AND b.ticks = e.ticks AND b.break_eob IS NOT DISTINCT FROM e.break_eob
 UNION ALL SELECT event_key, symbol, side, ticks, pair_kind, '30m', 'OBSERVING', observed_at FROM ev WHERE observed_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, side, ticks, pair_kind, '60m', 'FOCUS', focused_at FROM ev WHERE focused_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, side, ticks, pair_kind, '1d', 'ESTABLISHED', established_at FROM ev WHERE established_at IS NOT NULL),
moves AS (SELECT event_key, symbol, side, 'DISCOVERED' AS to_stage, discovered_at AS moment, 'FIVE_MINUTE_DISCOVERY' AS reason, false AS notify FROM ev
 UNION ALL SELECT event_key, symbol, side, 'OBSERVING', observed_at, 'SAME_PRICE_30M', true FROM ev WHERE observed_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, side, 'FOCUS', focused_at, 'SAME_PRICE_60M', true FROM ev WHERE focused_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, side, 'ESTABLISHED', established_at, 'SAME_PRICE_1D', true FROM ev WHERE established_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, side, 'INVALIDATED', break_eob, CASE WHEN side = 'TOP' THEN 'HIGHER_PRICE_BREAK' ELSE 'LOWER_PRICE_BREAK' END, observed_at IS NOT NULL FROM ev WHERE break_eob IS NOT NULL)"""


@query("event_hits", f"{HITS} SELECT event_key, symbol, frequency, stage, {stamp('eob')} FROM evidence")
def event_hits(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(spark, folder)[1].select("event_key", "symbol", "frequency", "stage", text("eob")["eob"].alias("eob"))


@query("hit_counters", f"{HITS} SELECT event_key, count(*) AS hits, count(*) FILTER (frequency <> '5m') AS promotions, count(*) FILTER (frequency = '5m') AS candidates, count(*) FILTER (pair_kind = 'ROUND_00') AS round_00, count(*) FILTER (pair_kind = 'DOUBLE_DIGIT') AS double_digit FROM evidence GROUP BY event_key")
def hit_counters(spark: SparkSession, folder: str) -> DataFrame:
    return P.hit_counters(replayed(spark, folder)[1])


@query("frequency_summary", f"{EVENTS} SELECT event_key, timeframe_mask AS mask, confluence, strongest_frequency AS strongest, frequencies FROM ev")
def frequency_summary(spark: SparkSession, folder: str) -> DataFrame:
    return P.frequency_summary(replayed(spark, folder)[1])


#: Faults planted so that the checks have something to count.
_FAULTY = """f AS (SELECT * REPLACE (CASE WHEN ticks % 5 = 0 THEN true ELSE is_active END AS is_active, CASE WHEN ticks % 3 = 0 THEN ticks ELSE break_ticks END AS break_ticks, CASE WHEN ticks % 4 = 0 THEN NULL ELSE established_at END AS established_at,
  CASE WHEN ticks % 7 = 0 THEN 'ESTABLISHED' ELSE stage END AS stage) FROM ev), fh AS (SELECT * REPLACE (CASE WHEN ticks % 6 = 0 THEN '1m' ELSE frequency END AS frequency) FROM evidence), fm AS (SELECT * REPLACE (notify OR side = 'TOP' AS notify) FROM moves)"""


def _checks_sql() -> str:
    n = lambda name, rows, c: f"SELECT '{name}' AS check_name, count(*) FILTER ({c}) AS n FROM {rows}"
    parts = [
        n("active_invalidated_stage", "f", "is_active AND stage = 'INVALIDATED'"), n("inactive_noninvalidated_stage", "f", "NOT is_active AND stage <> 'INVALIDATED'"),
        n("observing_without_30m_time", "f", "stage IN ('OBSERVING', 'FOCUS', 'ESTABLISHED') AND observed_at IS NULL"), n("focus_without_60m_time", "f", "stage IN ('FOCUS', 'ESTABLISHED') AND focused_at IS NULL"),
        n("established_without_day_time", "f", "stage = 'ESTABLISHED' AND established_at IS NULL"), n("top_invalidated_without_strict_break", "f", "side = 'TOP' AND stage = 'INVALIDATED' AND break_ticks <= ticks"),
        n("bottom_invalidated_without_strict_break", "f", "side = 'BOTTOM' AND stage = 'INVALIDATED' AND break_ticks >= ticks"),
        "SELECT 'duplicate_active_level', count(*) FILTER (c > 1) FROM (SELECT count(*) AS c FROM f WHERE is_active GROUP BY symbol, side, ticks)",
        *[n(k, "fh", f"stage = '{s}' AND frequency <> '{f}'") for k, s, f in (("discovery_not_5m", "DISCOVERED", "5m"), ("observing_not_30m", "OBSERVING", "30m"), ("focus_not_60m", "FOCUS", "60m"), ("established_not_1d", "ESTABLISHED", "1d"))],
        n("discovery_should_notify", "fm", "to_stage = 'DISCOVERED' AND notify"),
    ]
    return " UNION ALL ".join(parts)


@query("event_invariants", f"{HITS}, {_FAULTY} {_checks_sql()}")
def event_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """The checks over events with faults planted by price; tests hold those over the events themselves to zero."""
    e, hits, moves = replayed(spark, folder)
    by = lambda n, c, other: F.when(F.col("ticks") % n == 0, c).otherwise(other)
    faulty = e.withColumns({"is_active": by(5, F.lit(True), F.col("is_active")), "break_ticks": by(3, F.col("ticks"), F.col("break_ticks")), "established_at": by(4, None, F.col("established_at")), "stage": by(7, "ESTABLISHED", F.col("stage"))})
    told = moves.join(e.select("event_key", "side"), "event_key").withColumn("notify", F.col("notify") | (F.col("side") == "TOP"))
    return P.invariants(faulty, hits.withColumn("frequency", by(6, "1m", F.col("frequency"))), told)


@query(
    "roll_up_30m",
    f"""WITH {TICKS}, {bars_sql('5m', 'b')} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, CAST(floor(slot / 6) AS INTEGER) AS slot, arg_min(open_ticks, slot) AS open_ticks, max(high_ticks) AS high_ticks,
 min(low_ticks) AS low_ticks, arg_max(close_ticks, slot) AS close_ticks, sum(volume)::BIGINT AS volume, count(*) AS component_count, 6 AS expected_component_count FROM b GROUP BY symbol, b.trading_date, floor(slot / 6)""",
)
def roll_up_30m(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.roll_up(B.ticks_to_bars(A.ticks(spark, folder), "5m"), "30m")
    return rows.select("symbol", day(), "slot", *B.OHLC, "volume", "component_count", "expected_component_count")


@query(
    "source_differences",
    f"""WITH {TICKS}, {bars_sql('60m', 'b')}, o AS (SELECT * REPLACE (CASE WHEN slot = 2 THEN high_ticks + 1 ELSE high_ticks END AS high_ticks, CASE WHEN volume % 4 = 0 THEN 0 ELSE volume END AS volume) FROM b WHERE volume % 5 <> 0),
u AS ({' UNION ALL '.join(f"SELECT coalesce(o.symbol, b.symbol) AS symbol, coalesce(o.trading_date, b.trading_date) AS d, coalesce(o.slot, b.slot) AS slot, '{c}' AS field, o.{c} AS a, b.{c} AS b FROM b LEFT JOIN o USING (symbol, trading_date, slot)" for c in B.FACTS)})
SELECT symbol, strftime(d, '%Y-%m-%d') AS trading_date, slot, field, a, b FROM u WHERE a IS DISTINCT FROM b""",
)
def source_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Official 60-minute bars, some of them changed or missing, against those rolled up."""
    ticks = A.ticks(spark, folder)
    official = B.ticks_to_bars(ticks, "60m").filter("volume % 5 <> 0").withColumns({"high_ticks": F.when(F.col("slot") == 2, F.col("high_ticks") + 1).otherwise(F.col("high_ticks")), "volume": F.when(F.col("volume") % 4 == 0, 0).otherwise(F.col("volume"))})
    rows = B.compare_sources(official, B.roll_up(B.ticks_to_bars(ticks, "5m"), "60m"), ["symbol", "trading_date", "slot"], B.FACTS)
    return rows.select("symbol", day(), "slot", "field", "a", "b")


@query(
    "roll_up_check",
    f"""WITH {TICKS}, {', '.join(bars_sql(f, f'b{f}') for f in ('30m', '60m', '1d'))} SELECT symbol, frequency, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, {', '.join(B.FACTS)} FROM (SELECT * FROM b30m UNION ALL SELECT * FROM b60m UNION ALL SELECT * FROM b1d)""",
)
def roll_up_check(spark: SparkSession, folder: str) -> DataFrame:
    """The longer bars as the replay has them, rolled up, against bars built from ticks."""
    b = intraday(spark, folder)
    rows = b["30m"].unionByName(b["60m"]).unionByName(b["1d"])
    return rows.select("symbol", "frequency", day(), "slot", *B.FACTS)


@query(
    "active_bars",
    f"""WITH {TICKS}, {', '.join(bars_sql(f, f'b{f}') for f in ('1m', '5m', '30m'))} SELECT symbol, frequency, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, {', '.join(B.OHLC)}, volume, tick_count FROM (SELECT * FROM b1m UNION ALL SELECT * FROM b5m UNION ALL SELECT * FROM b30m)""",
)
def active_bars(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.active_bars(A.ticks(spark, folder), ["1m", "5m", "30m"])
    return rows.select("symbol", "frequency", day(), "slot", *B.OHLC, "volume", "tick_count")


@query(
    "gaps_5m",
    f"""WITH {TICKS}, {bars_sql('5m', 'b')}, d AS (SELECT DISTINCT symbol, trading_date FROM ticks), e AS (SELECT symbol, trading_date, unnest(range(48))::INTEGER AS slot FROM d),
m AS (SELECT e.* FROM e ANTI JOIN b USING (symbol, trading_date, slot)), r AS (SELECT *, slot - row_number() OVER (PARTITION BY symbol, trading_date ORDER BY slot) AS run FROM m),
g AS (SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, min(slot) AS from_slot, max(slot) AS to_slot, count(*) AS missing FROM r GROUP BY symbol, r.trading_date, run)
SELECT *, sha256(concat_ws('|', symbol, '5m', trading_date, from_slot, to_slot)) AS gap_key, '5m' AS frequency, 'warning' AS severity FROM g""",
)
def gaps_5m(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    rows = B.detect_gaps(ticks.select("symbol", "trading_date").distinct(), B.ticks_to_bars(ticks, "5m"), "5m")
    return rows.withColumn("trading_date", day())


@query(
    "gap_totals_30m",
    f"""WITH {TICKS}, {bars_sql('30m', 'b')}, d AS (SELECT DISTINCT symbol, trading_date FROM ticks), e AS (SELECT symbol, trading_date, unnest(range(8))::INTEGER AS slot FROM d),
t AS (SELECT e.*, CAST(e.trading_date AS TIMESTAMP) + to_minutes(CASE WHEN (slot + 1) * 30 <= 120 THEN (slot + 1) * 30 + 570 ELSE (slot + 1) * 30 + 660 END) AS ends FROM e)
SELECT count(*) AS expected, count(b.slot) AS existing, count(*) FILTER (b.slot IS NULL) AS missing FROM t LEFT JOIN b USING (symbol, trading_date, slot) WHERE ends + INTERVAL 90 SECOND <= TIMESTAMP '{CUTOFF}'""",
)
def gap_totals_30m(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    return B.gap_totals(ticks.select("symbol", "trading_date").distinct(), B.ticks_to_bars(ticks, "30m"), "30m", cutoff())


@query(
    "coverage_5m",
    f"""WITH {TICKS}, {bars_sql('5m', 'b')} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, 48 AS expected, count(*) AS received, 48 - count(*) AS missing, count(*) = 48 AS complete FROM b GROUP BY symbol, b.trading_date""",
)
def coverage_5m(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.ticks_to_bars(A.ticks(spark, folder), "5m").groupBy("symbol", "trading_date").agg(F.count("*").alias("received"))
    n = F.col("received")
    return rows.select("symbol", day(), F.lit(48).alias("expected"), "received", (48 - n).alias("missing"), (n == 48).alias("complete"))


@query(
    "quality_issues_30m",
    f"""WITH {TICKS}, {bars_sql('5m', 'b')}, d AS (SELECT DISTINCT symbol, trading_date FROM ticks), r0 AS (SELECT symbol, trading_date, CAST(floor(slot / 6) AS INTEGER) AS slot, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks, sum(volume)::BIGINT AS volume, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT symbol, trading_date, CASE WHEN slot = 7 THEN 9 ELSE slot END AS slot, n, volume % 11 = 0 OR high_ticks % 13 = 0 AND high_ticks > low_ticks AS bad, volume % 11 = 0 AS negative FROM r0 UNION ALL SELECT symbol, trading_date, slot, n, volume % 11 = 0 OR high_ticks % 13 = 0 AND high_ticks > low_ticks, volume % 11 = 0 FROM r0 WHERE slot = 1),
q AS (SELECT symbol, trading_date, 'incomplete_components' AS check_type, 'warning' AS severity, count(*) AS n FROM r WHERE n < 6 GROUP BY ALL
  UNION ALL SELECT symbol, trading_date, 'invalid_ohlc', 'error', count(*) FROM r WHERE bad GROUP BY ALL UNION ALL SELECT symbol, trading_date, 'negative_volume', 'error', count(*) FROM r WHERE negative GROUP BY ALL
  UNION ALL SELECT symbol, trading_date, 'slot_misaligned', 'error', count(*) FROM r WHERE slot > 7 GROUP BY ALL UNION ALL SELECT symbol, trading_date, 'duplicate_slots', 'error', count(*) - count(DISTINCT slot) FROM r GROUP BY ALL HAVING count(*) > count(DISTINCT slot)
  UNION ALL SELECT d.symbol, d.trading_date, 'missing_slots', 'warning', 8 - count(DISTINCT r.slot) FILTER (r.slot < 8) FROM d LEFT JOIN r USING (symbol, trading_date) GROUP BY ALL HAVING count(DISTINCT r.slot) FILTER (r.slot < 8) < 8)
SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, check_type, severity, n FROM q""",
)
def quality_issues_30m(spark: SparkSession, folder: str) -> DataFrame:
    """Over 30-minute bars with faults planted: a slot off the grid, a repeated slot, negative volumes, highs below lows."""
    ticks = A.ticks(spark, folder)
    rows = B.roll_up(B.ticks_to_bars(ticks, "5m"), "30m")
    rows = rows.withColumns({"high_ticks": F.when((F.col("high_ticks") % 13 == 0) & (F.col("high_ticks") > F.col("low_ticks")), F.col("low_ticks") - 1).otherwise(F.col("high_ticks")), "volume": F.when(F.col("volume") % 11 == 0, -1).otherwise(F.col("volume"))})
    rows = rows.withColumn("slot", F.when(F.col("slot") == 7, 9).otherwise(F.col("slot"))).unionByName(rows.filter("slot = 1"))
    return B.quality_issues(rows, ticks.select("symbol", "trading_date").distinct(), "30m").withColumn("trading_date", day())


@query("latest_quotes", f"WITH {TICKS} SELECT symbol, {stamp('event_time')}, price_ticks, event_id FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ticks.event_time DESC, event_id DESC) = 1")
def latest_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return B.latest_quotes(A.ticks(spark, folder)).withColumns(text("event_time"))


@query("checkpoints", f"{BARS} SELECT symbol, frequency, {stamp('max(eob)', 'last_eob')}, count(*) AS bars FROM (SELECT symbol, frequency, eob FROM b5m UNION ALL SELECT symbol, frequency, eob FROM b1d) GROUP BY symbol, frequency")
def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    b = intraday(spark, folder)
    own = lambda f: b[f].select("symbol", "frequency", "eob")
    return B.checkpoints(own("5m").unionByName(own("1d"))).withColumns(text("last_eob"))


@query("last_bars_30m", f"{BARS} SELECT symbol, close_ticks, {stamp('eob')}, row_number() OVER (PARTITION BY symbol ORDER BY b30m.eob DESC)::INTEGER AS age FROM b30m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY b30m.eob DESC) <= 60")
def last_bars_30m(spark: SparkSession, folder: str) -> DataFrame:
    return B.last_n(intraday(spark, folder)["30m"], 60).select("symbol", "close_ticks", text("eob")["eob"].alias("eob"), "age")


@query(
    "volume_deltas",
    f"""WITH {TICKS}, a AS (SELECT *, CASE WHEN event_id % 17 = 0 THEN event_time - INTERVAL 1 HOUR ELSE event_time END AS t, CASE WHEN event_id % 3 = 0 THEN volume END AS last_volume FROM ticks),
c AS (SELECT *, sum(volume) OVER (PARTITION BY symbol, trading_date ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cumulative_volume FROM a),
p AS (SELECT *, max(t) OVER w AS seen, max(cumulative_volume) OVER w AS before FROM c WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CASE WHEN t < seen THEN 0 WHEN last_volume IS NOT NULL THEN last_volume ELSE greatest(cumulative_volume - coalesce(before, 0), 0) END::BIGINT AS volume_delta FROM p""",
)
def volume_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks of which some come late and a third carry their own trade volume."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "trading_date").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = A.ticks(spark, folder).withColumns(
        {"event_time": F.when(F.col("event_id") % 17 == 0, F.timestamp_add("HOUR", F.lit(-1), F.col("event_time"))).otherwise(F.col("event_time")), "last_volume": F.when(F.col("event_id") % 3 == 0, F.col("volume")), "cumulative_volume": F.sum("volume").over(w)}
    )
    return B.with_volume_delta(rows).select("event_id", "volume_delta")
