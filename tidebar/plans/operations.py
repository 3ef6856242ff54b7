"""Registered queries of universe, intraday features, maintenance and notifications, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import daily as D
from tidebar.operators import intraday as I
from tidebar.operators import maintain as M
from tidebar.operators import pairs as P
from tidebar.operators import signals as S
from tidebar.operators import universe as U
from tidebar.operators.signals import filter_runs
from tidebar.plans.market import CUTOFF, EVENTS, HITS, QUERIES, SQL, TICKS, bars_sql, cutoff, day, events, query, replayed, stamp, text
from tidebar.plans.research import DAILY, SIGNALS, mean, percent, rounded
from tidebar.sources import adapters as A

__all__ = ["QUERIES", "SQL"]

RAW = """raw AS (
  SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'SHSE.900' WHEN s_nationkey % 2 = 0 THEN 'SHSE.600' ELSE 'SZSE.300' END || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') AS symbol, CASE WHEN s_suppkey % 7 = 0 THEN '*st ' || s_name ELSE s_name END AS name,
         (s_suppkey + day(t)) % 17 = 0 AS is_suspended, CASE WHEN s_suppkey % 3 = 0 THEN '{"sec_level": ' || CAST(s_suppkey % 4 AS VARCHAR) || '}' WHEN s_suppkey % 3 = 1 THEN '{"_universe_adapter": "get_symbols"}' WHEN s_suppkey % 4 = 0 THEN '{"_universe_adapter": "get_instruments-current-snapshot"}' ELSE '{}' END AS raw_attributes, t AS trading_date, s_suppkey
  FROM supplier, (SELECT DISTINCT CAST(ts AS DATE) AS t FROM events))"""
UNIVERSE = f"""WITH {RAW}, lv AS (SELECT *, CAST(json_extract(raw_attributes, '$.sec_level') AS INTEGER) AS level, regexp_matches(symbol, '^(SHSE\\.(600|601|603|605|688)|SZSE\\.(000|001|002|003|300|301))[0-9]{{3}}$') AS is_a_share FROM raw),
st AS (SELECT *, CASE WHEN level IS NOT NULL THEN level IN (2, 3) ELSE regexp_matches(upper(replace(name, ' ', '')), '^\\*?ST') END AS is_st FROM lv),
uni AS (SELECT *, is_a_share AND NOT is_st AND NOT is_suspended AS is_eligible, CASE WHEN NOT is_a_share THEN 'NOT_A_SHARE' WHEN is_st THEN 'ST' END AS exclusion_reason, coalesce(json_extract_string(raw_attributes, '$._universe_adapter'), 'legacy_unknown') AS status_source, CASE json_extract_string(raw_attributes, '$._universe_adapter') WHEN 'get_instruments-current-snapshot' THEN 'estimated_current_snapshot' WHEN 'get_symbols' THEN 'historical_exact' ELSE 'unknown' END AS status_quality FROM st)"""


#: Instruments of a task of the universe: it makes a row of each for every trading day.
INSTRUMENTS_A_TASK = 10_000


def universe(spark: SparkSession, folder: str) -> DataFrame:
    s = A.table(spark, folder, "supplier")
    s = s.repartition(s.count() // INSTRUMENTS_A_TASK + 1)  # the file is one task, whatever its rows become
    dates = A.table(spark, folder, "events").select(F.to_date("ts").alias("trading_date")).distinct()
    key = F.col("s_suppkey")
    prefix = F.when(key % 5 == 0, "SHSE.900").when(F.col("s_nationkey") % 2 == 0, "SHSE.600").otherwise("SZSE.300")
    level = F.when(key % 3 == 0, F.concat(F.lit('{"sec_level": '), (key % 4).cast("string"), F.lit("}")))
    level = level.when(key % 3 == 1, '{"_universe_adapter": "get_symbols"}').when(key % 4 == 0, '{"_universe_adapter": "get_instruments-current-snapshot"}').otherwise("{}")
    name = F.when(key % 7 == 0, F.concat(F.lit("*st "), "s_name")).otherwise(F.col("s_name"))
    rows = s.crossJoin(F.broadcast(dates)).select(  # symbols x trading days is what a universe is; a row a trading day is broadcast
        F.concat(prefix, F.lpad((key % 1000).cast("string"), 3, "0")).alias("symbol"), name.alias("name"), ((key + F.dayofmonth("trading_date")) % 17 == 0).alias("is_suspended"),
        level.alias("raw_attributes"), "trading_date", "s_suppkey",
    )
    return U.classify(rows)


@query("universe", f"{UNIVERSE} SELECT symbol, name, strftime(trading_date, '%Y-%m-%d') AS trading_date, is_a_share, is_st, is_eligible, exclusion_reason, status_source, status_quality FROM uni")
def universe_rows(spark: SparkSession, folder: str) -> DataFrame:
    return universe(spark, folder).select("symbol", "name", day(), "is_a_share", "is_st", "is_eligible", "exclusion_reason", "status_source", "status_quality")


@query("universe_totals", f"{UNIVERSE} SELECT strftime(trading_date, '%Y-%m-%d') AS trading_date, count(*) AS total, count(*) FILTER (is_eligible) AS eligible, count(*) FILTER (is_st) AS special, count(*) FILTER (is_suspended) AS suspended FROM uni GROUP BY uni.trading_date")
def universe_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = universe(spark, folder).groupBy("trading_date").agg(F.count("*").alias("total"), F.count_if("is_eligible").alias("eligible"), F.count_if("is_st").alias("special"), F.count_if("is_suspended").alias("suspended"))
    return rows.withColumn("trading_date", day())


@query("eligible_at", f"{UNIVERSE} SELECT symbol FROM uni WHERE is_eligible AND trading_date = (SELECT coalesce(max(trading_date) FILTER (trading_date <= DATE '2024-01-15'), max(trading_date)) FROM uni) ORDER BY symbol LIMIT 10000")
def eligible_at(spark: SparkSession, folder: str) -> DataFrame:
    return U.eligible_at(universe(spark, folder), F.lit("2024-01-15").cast("date"))


@query("eligible_before_all", f"{UNIVERSE} SELECT symbol FROM uni WHERE is_eligible AND trading_date = (SELECT max(trading_date) FROM uni) ORDER BY symbol LIMIT 10000")
def eligible_before_all(spark: SparkSession, folder: str) -> DataFrame:
    """Of a day before all statuses: the newest ones count."""
    return U.eligible_at(universe(spark, folder), F.lit("2000-01-03").cast("date"))


@query("run_filter", "SELECT o_orderkey AS run_id, o_orderpriority AS profile, o_orderstatus AS status FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def run_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Runs by profile and status: orders as runs."""
    runs = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("status"))
    return filter_runs(runs, "1-URGENT", "F")


@query(
    "universe_readiness",
    f"""{UNIVERSE}, c AS (SELECT DISTINCT trading_date, (SELECT count(*) FROM supplier) AS certified_total, dayofmonth(trading_date) % 7 <> 0 AS is_trading_day FROM raw),
k AS (SELECT trading_date, count(*) AS total, count(*) FILTER (is_eligible) AS eligible, count(DISTINCT symbol) AS symbols FROM uni GROUP BY ALL)
SELECT strftime(trading_date, '%Y-%m-%d') AS trading_date, is_trading_day, total, symbols, CASE WHEN is_trading_day THEN total = certified_total AND symbols = total AND total > 0 ELSE total = certified_total AND symbols = total AND total = 0 END AS ready FROM c JOIN k USING (trading_date)""",
)
def universe_readiness(spark: SparkSession, folder: str) -> DataFrame:
    u = universe(spark, folder)
    n = A.table(spark, folder, "supplier").agg(F.count("*").alias("certified_total"))
    eligible = u.groupBy("trading_date").agg(F.count_if("is_eligible").alias("certified_eligible"))
    certificates = eligible.crossJoin(n).withColumn("is_trading_day", F.dayofmonth("trading_date") % 7 != 0)  # one row
    return U.readiness(certificates, u).select(day(), "is_trading_day", "total", "symbols", "ready")


@query(
    "exact_cover_5m",
    f"""WITH {TICKS}, {bars_sql('5m', 'b')}, d AS (SELECT DISTINCT symbol, trading_date FROM ticks), e AS (SELECT symbol, trading_date, unnest(range(48))::INTEGER AS slot FROM d),
x AS (SELECT e.*, b.slot IS NOT NULL AS received, b.slot IS NULL AND e.slot % 3 = 0 AS proven FROM e LEFT JOIN b USING (symbol, trading_date, slot))
SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, count(*) AS expected, count(*) FILTER (received) AS received, count(*) FILTER (proven) AS proven, 0::BIGINT AS extra, count(*) FILTER (NOT received AND NOT proven) AS unexplained, bool_and(received OR proven) AS complete FROM x GROUP BY symbol, x.trading_date""",
)
def exact_cover_5m(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    bars = B.ticks_to_bars(ticks, "5m")
    days = ticks.select("symbol", "trading_date").distinct()
    proofs = B.missing_slots(days, bars, "5m").filter("slot % 3 = 0").withColumn("confirmations", F.lit(3))
    return U.cover(B.expected_slots(days, "5m"), bars, proofs, ["symbol", "trading_date"], "slot").withColumn("trading_date", day())


M1 = f"""WITH {TICKS}, {bars_sql('1m', 'm')}, v AS (SELECT *, coalesce(sum(amount_ticks) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER (w ROWS UNBOUNDED PRECEDING), 0)::DOUBLE, close_ticks) AS vwap, sum(volume) OVER (w ROWS UNBOUNDED PRECEDING) > 0 AS traded, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY slot)),
r AS (SELECT *, n - coalesce(max(CASE WHEN NOT (traded AND close_ticks >= vwap) THEN n END) OVER (PARTITION BY symbol, trading_date ORDER BY slot ROWS UNBOUNDED PRECEDING), 0) AS run_above FROM v)"""


@query("vwap_runs", f"{M1} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, round(vwap, 4) AS vwap, run_above FROM r")
def vwap_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = I.with_vwap(B.ticks_to_bars(A.ticks(spark, folder), "1m"))
    return rounded(rows, "vwap").select("symbol", day(), "slot", "vwap", "run_above")


FEATURES = M1 + """, f AS (SELECT *, avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last5, CASE WHEN n >= 10 THEN avg(volume) OVER (w ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) END AS prior5,
 coalesce(volume >= lag(volume) OVER w AND lag(volume) OVER w >= lag(volume, 2) OVER w, false) AS rising, max(high_ticks) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS platform, lag(close_ticks, 5) OVER w AS ago, avg(volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last3, CASE WHEN n >= 6 THEN avg(volume) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) END AS prior3,
 list({'l': low_ticks, 'c': close_ticks, 'v': vwap}) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS last8 FROM r WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY slot)),
a AS (SELECT symbol, trading_date, arg_min(open_ticks, slot) AS day_open, max(high_ticks) AS day_high, min(low_ticks) AS day_low, sum(volume)::BIGINT AS volume, sum(amount_ticks)::BIGINT AS amount_ticks, count(*) AS bars, max(slot) AS slot FROM f GROUP BY symbol, trading_date),
d AS (SELECT a.*, f.close_ticks AS price, f.vwap, f.run_above, last5, prior5, rising, platform, ago, last3, prior3, last8 FROM a JOIN f USING (symbol, trading_date, slot)),
""" + f"""z AS (SELECT slot, coalesce(CASE WHEN prior3 > 0 THEN last3 / prior3 END, 0) AS recent3,
 CASE WHEN len(last8) >= 4 THEN last8[-1].c >= last8[-1].v AND last8[-2].c >= last8[-2].v AND len(list_filter(last8[1:len(last8) - 2], lambda b: b.l >= b.v * 0.997 AND b.c >= b.v AND (last8[-1].c - b.c) / b.c::DOUBLE * 100 >= 0.2)) > 0 ELSE false END AS restart, symbol, trading_date, day_open, day_high, day_low, price, volume, amount_ticks, bars, vwap, run_above, {percent('price', 'day_open')} AS from_open, {percent('price', 'vwap')} AS above_vwap, (day_high - price) / day_high::DOUBLE * 100 AS pullback,
 CASE WHEN day_high > day_low THEN (price - day_low) / (day_high - day_low)::DOUBLE ELSE 1 END AS close_position, CASE WHEN day_high > day_low THEN (day_high - greatest(day_open, price)) / (day_high - day_low)::DOUBLE ELSE 0 END AS upper_wick,
 coalesce(CASE WHEN prior5 > 0 THEN last5 / prior5 END, 0) AS acceleration, rising AS volume_sustained, {percent('price', 'coalesce(ago, 0)')} AS return_5, CASE WHEN platform > 0 THEN {percent('price', 'platform')} ELSE 0 END AS platform_breakout FROM d)"""
_REALS = ["vwap", "from_open", "above_vwap", "pullback", "close_position", "upper_wick", "acceleration", "return_5", "platform_breakout", "recent3"]
_WHOLE = ["day_open", "day_high", "day_low", "price", "volume", "amount_ticks", "bars", "run_above", "volume_sustained", "slot", "restart"]


def features(spark: SparkSession, folder: str) -> DataFrame:
    return I.day_features(B.ticks_to_bars(A.ticks(spark, folder), "1m"))


@query("day_features", f"{FEATURES} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, {', '.join(_WHOLE)}, {', '.join(f'round({c}, 4) AS {c}' for c in _REALS)} FROM z")
def day_features(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(features(spark, folder), *_REALS).select("symbol", day(), *_WHOLE, *_REALS)


# daily bars of the ten listed symbols stand in as history of the twenty that tick
HISTORY = f"""{FEATURES}, {bars_sql('30m', 'b30m')}, {DAILY}, hist AS (SELECT 'U' || CAST(k AS VARCHAR) AS symbol, trading_date AS d, * EXCLUDE (symbol, trading_date) FROM (SELECT unnest(range(20)) AS k) JOIN daily ON daily.symbol = 'S' || CAST(k % 10 AS VARCHAR)),
m3 AS (SELECT symbol, trading_date, eob, open_ticks AS o, high_ticks AS h, low_ticks AS l, close_ticks AS c, volume, avg(volume) OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mean FROM b30m),
m30 AS (SELECT symbol, trading_date, CASE WHEN mean > 0 THEN volume / mean ELSE 0 END AS m30_volume_ratio, CASE WHEN h > l THEN (c - l) / (h - l)::DOUBLE ELSE 1 END AS m30_close_position, CASE WHEN h > l THEN (h - greatest(o, c)) / (h - l)::DOUBLE ELSE 0 END AS m30_upper_wick, c > o AS m30_bullish
 FROM m3 QUALIFY row_number() OVER (PARTITION BY symbol, trading_date ORDER BY m3.eob DESC) = 1),
av AS (SELECT symbol, d, close_ticks AS last_close, {', '.join(f'{mean(n)} AS ma{n}' for n in (5, 10, 20, 30, 60))}, {mean(20, 1)} AS ma20_before, lag(close_ticks, 4) OVER w AS four_ago, avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean_volume, row_number() OVER w AS i,
 count(*) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n15, avg(volume) OVER (w ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING) AS old FROM hist WINDOW w AS (PARTITION BY symbol ORDER BY d)),
st AS (SELECT symbol, last_close, ma5, ma10, ma20, ma30, ma60, CASE WHEN i >= 21 THEN {percent('ma20', 'ma20_before')} ELSE 0 END AS ma20_slope, {percent('ma20', 'ma60')} AS trend_strength, CASE WHEN n15 >= 15 AND old > 0 THEN mean_volume / old ELSE 0 END AS pullback_volume_ratio,
 coalesce(least(CASE WHEN ma20 > 0 THEN ma20 END, CASE WHEN ma30 > 0 THEN ma30 END), 0) AS support, four_ago, mean_volume FROM av QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1),
wk AS (SELECT symbol, date_trunc('week', d) AS week, max(high_ticks) AS h, min(low_ticks) AS l FROM hist GROUP BY ALL),
wn AS (SELECT symbol, week, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) AS a, h, l FROM wk),
wp AS (SELECT symbol, count(*) AS nw, max(h) FILTER (a <= 24) AS hi, min(l) FILTER (a <= 24) AS lo, max(h) FILTER (a <= 12) AS hi12, min(l) FILTER (a <= 12) AS lo12, list(h) FILTER (a <= 24) AS hs FROM wn GROUP BY symbol),
pl AS (SELECT symbol, CASE WHEN nw >= 12 THEN hi ELSE 0 END AS platform_high, CASE WHEN nw >= 12 THEN lo ELSE 0 END AS platform_low, CASE WHEN nw >= 12 THEN {percent('hi', 'lo')} ELSE 0 END AS range_24, CASE WHEN nw >= 12 THEN {percent('hi12', 'lo12')} ELSE 0 END AS range_12,
 CASE WHEN nw >= 12 THEN len(list_filter(hs, lambda q: q >= hi * 0.97)) ELSE 0 END AS touches FROM wp),
hn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS a FROM hist), hl AS (SELECT symbol, count(*) AS n, list(high_ticks ORDER BY d) AS h, list(low_ticks ORDER BY d) AS l, list(close_ticks::DOUBLE ORDER BY d) AS c FROM hn WHERE a <= 140 GROUP BY symbol),
w1 AS (SELECT *, list_position(h, list_max(h)) AS i FROM hl), w2 AS (SELECT *, list_min(l[i + 1:n]) AS low FROM w1), w3 AS (SELECT *, i + list_position(l[i + 1:n], low) AS j FROM w2), w4 AS (SELECT *, list_max(h[j + 1:n]) AS rise FROM w3), w5 AS (SELECT *, j + list_position(h[j + 1:n], rise) AS k FROM w4),
w6 AS (SELECT *, l[least(k + 1, n):n] AS rest, n >= 120 AND i <= n - 20 AS known FROM w5), w7 AS (SELECT *, list_min(rest) AS second, known AND coalesce(j <= n - 5, false) AS whole FROM w6),
snap0 AS (SELECT z.*, m30.* EXCLUDE (symbol, trading_date), st.* EXCLUDE (symbol), pl.* EXCLUDE (symbol), last_close AS pre_close, {percent('price', 'last_close')} AS change, {percent('day_open', 'last_close')} AS gap, coalesce(CASE WHEN mean_volume > 0 THEN volume / (mean_volume * (slot + 1) / 240.0) END, 0) AS volume_ratio,
 {percent('price', 'four_ago')} AS five_day_return, {percent('price', 'support')} AS distance_from_support, amount_ticks / 100.0::DOUBLE AS amount, CASE WHEN n < 60 THEN 'FEW_DAILY_BARS' ELSE 'READY' END AS readiness, CAST(substr(symbol, 2) AS INTEGER) % 2 = 1 AS growth,
 CASE WHEN whole THEN (list_max(h) - low) / list_max(h)::DOUBLE * 100 WHEN known THEN {percent('low', 'list_max(h)')} ELSE 0 END AS decline, CASE WHEN whole THEN {percent('rise', 'low')} ELSE 0 END AS rebound, CASE WHEN whole THEN {percent('price', 'second')} ELSE 0 END AS repair,
 whole AND len(rest) >= 2 AND second >= low * 0.98 AND second <= rise * 0.97 AS second_bottom, whole AND price > greatest(list_avg(c[n - 9:n]), list_avg(c[n - 19:n])) AS breaks_trend
 FROM z JOIN m30 USING (symbol, trading_date) JOIN st USING (symbol) JOIN pl USING (symbol) JOIN w7 USING (symbol)),
snap AS (SELECT *, change - avg(change) OVER (PARTITION BY trading_date) AS relative_strength, avg(change) OVER (PARTITION BY trading_date) AS market_change FROM snap0)"""
_SNAP_REALS = [
    *_REALS, *[c for c in (*I.M30, *I.HISTORY, *I.WEEKS, *I.WAVE) if c not in ("m30_bullish", "second_bottom", "breaks_trend", "touches", "platform_high", "platform_low")],
    "change", "gap", "volume_ratio", "five_day_return", "distance_from_support", "amount", "relative_strength", "market_change",
]
_SNAP_WHOLE = [*_WHOLE, "m30_bullish", "second_bottom", "breaks_trend", "touches", "platform_high", "platform_low", "pre_close", "readiness"]


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    ticks = A.ticks(spark, folder)
    symbols = ticks.select("symbol").distinct().withColumn("_s", F.concat(F.lit("S"), (F.substring("symbol", 2, 9).cast("int") % 10).cast("string")))
    history = A.daily_bars(spark, folder).withColumnRenamed("symbol", "_s").join(F.broadcast(symbols), "_s").drop("_s")  # as many rows as symbols tick
    m1, m30 = B.ticks_to_bars(ticks, "1m"), B.ticks_to_bars(ticks, "30m")
    quotes = m1.groupBy("symbol", "trading_date").agg(F.max_by("close_ticks", "slot").alias("price_ticks")).withColumn("pre_close", F.lit(None).cast("long"))
    market = D.with_prev_close(quotes, history).groupBy("trading_date").agg(F.avg("change_percent").alias("market_change"))
    rows = I.snapshots(m1, m30, history, market)
    return rows.withColumn("growth", F.substring("symbol", 2, 9).cast("int") % 2 == 1)


@query("snapshots", f"{HISTORY} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, {', '.join(_SNAP_WHOLE)}, {', '.join(f'round({c}, 4) AS {c}' for c in _SNAP_REALS)} FROM snap")
def snapshot_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(snapshots(spark, folder), *_SNAP_REALS).select("symbol", day(), *_SNAP_WHOLE, *_SNAP_REALS)


@query("quote_change", f"""{HISTORY} SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, p AS prev_close, round(CASE WHEN p > 0 THEN {percent('price', 'p')} END, 4) AS change_percent FROM (SELECT *, CASE WHEN price % 2 = 0 THEN price - 100 ELSE last_close END AS p FROM snap)""")
def quote_change(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of which half bring their previous close along."""
    rows = snapshots(spark, folder).select("symbol", "trading_date", F.col("price").alias("price_ticks"), F.when(F.col("price") % 2 == 0, F.col("price") - 100).alias("pre_close"))
    symbols = rows.select("symbol").distinct().withColumn("_s", F.concat(F.lit("S"), (F.substring("symbol", 2, 9).cast("int") % 10).cast("string")))
    history = A.daily_bars(spark, folder).withColumnRenamed("symbol", "_s").join(F.broadcast(symbols), "_s").drop("_s")
    return rounded(D.with_prev_close(rows, history), "change_percent").select("symbol", day(), "prev_close", "change_percent")


#: Limits that some of the synthetic days pass.
SCALED = I.LIMITS | {
    "turnover": 5000, "minutes": 6, "rise": -50, "day_gain": 1e9, "candidate_low": 0, "confirm_low": 0, "pullback_high": 80, "candidate_run": 1, "confirm_run": 2, "candidate_pace": 0.5, "confirm_pace": 0.8, "recent3": 0.5,
    "return_5": -50, "breakout": -90, "gap_main": -100, "gap_growth": -100, "restart_rise": -50, "restart_gain": 1e9, "restart_above": -50, "restart_pullback": 80,
}


def _rules_sql(limits: dict) -> str:
    parts = []
    for (rule, branch), conditions in I.rules(limits).items():
        names = lambda no: ", ".join(f"CASE WHEN {no} coalesce({c}, false) THEN '{k}' END" for k, c in conditions.items())  # noqa: E731, B023
        met = " + ".join(f"coalesce({c}, false)::INT" for c in conditions.values())
        parts.append(f"SELECT symbol, trading_date, '{rule}' AS rule, '{branch}' AS branch, concat_ws(',', {names('')}) AS met, concat_ws(',', {names('NOT')}) AS missed, round(100 * ({met}) / {len(conditions)}::DOUBLE, 4) AS score, ({met}) = {len(conditions)} AS passed FROM snap")
    return " UNION ALL ".join(parts)


def _funnel_sql(limits: dict) -> str:
    parts = []
    for (rule, branch), conditions in I.rules(limits).items():
        for i, k in enumerate(conditions):
            came = " AND ".join(["true", *[f"coalesce({c}, false)" for c in list(conditions.values())[:i]]])
            parts.append(f"SELECT '{rule}' AS rule, '{branch}' AS branch, {i + 1} AS step, '{k}' AS condition, count(*) AS evaluated, count(*) FILTER (coalesce({conditions[k]}, false)) AS passed FROM snap WHERE {came} HAVING count(*) > 0")
    return " UNION ALL ".join(parts)


@query("rule_evaluations", f"{HISTORY}, ruled AS ({_rules_sql(I.LIMITS)}) SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, rule, branch, met, missed, score, passed FROM ruled")
def rule_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """By the published limits."""
    rows = I.evaluate(snapshots(spark, folder))
    return rows.withColumns({"trading_date": day(), "met": F.array_join("met", ","), "missed": F.array_join("missed", ",")})


@query(
    "rule_decisions",
    f"""{HISTORY}, ruled AS ({_rules_sql(SCALED)}), dc AS (SELECT symbol, trading_date, rule, bool_or(branch = 'confirm' AND passed) AS c, bool_or(branch = 'candidate' AND passed) AS d, max(score) AS score FROM ruled GROUP BY ALL)
SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, rule, score, CASE WHEN c THEN 'CONFIRM' WHEN d THEN 'CANDIDATE' ELSE 'NONE' END AS action FROM dc""",
)
def rule_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """By limits scaled to the synthetic prices."""
    return I.decisions(I.evaluate(snapshots(spark, folder), SCALED)).withColumn("trading_date", day())


@query("rule_funnel", f"{HISTORY} {_funnel_sql(SCALED)}")
def rule_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return I.funnel(I.evaluate(snapshots(spark, folder), SCALED), SCALED)


@query(
    "merged_bars",
    f"""WITH {TICKS}, {bars_sql('60m', 'b')}, h AS (SELECT symbol, trading_date, slot, sha256(concat_ws('|', open_ticks, high_ticks, low_ticks, close_ticks, volume, amount_ticks)) AS row_hash FROM b),
s AS (SELECT symbol, trading_date, slot, CASE WHEN slot = 1 THEN 'old' ELSE row_hash END AS row_hash, slot AS revision, CASE WHEN day(trading_date) % 2 = 0 THEN 300 ELSE 400 END AS p FROM h WHERE slot <> 2),
m AS (SELECT h.symbol, h.trading_date, h.slot, s.row_hash IS NULL AS fresh, coalesce(h.row_hash <> s.row_hash AND p <= 300, false) AS again, h.row_hash AS nh, s.row_hash AS oh, revision, p FROM h LEFT JOIN s USING (symbol, trading_date, slot))
SELECT symbol, strftime(trading_date, '%Y-%m-%d') AS trading_date, slot, CASE WHEN fresh OR again THEN nh ELSE oh END AS row_hash, CASE WHEN fresh THEN 0 WHEN again THEN revision + 1 ELSE revision END AS revision, CASE WHEN fresh OR again THEN 300 ELSE p END AS source_priority,
 CASE WHEN fresh THEN 'BarClosed' WHEN again THEN 'BarRevised' END AS event_type FROM m""",
)
def merged_bars(spark: SparkSession, folder: str) -> DataFrame:
    key = ["symbol", "trading_date", "slot"]
    new = B.with_row_hash(B.ticks_to_bars(A.ticks(spark, folder), "60m")).withColumn("source_priority", F.lit(300))
    old = new.filter("slot <> 2").withColumns(
        {"row_hash": F.when(F.col("slot") == 1, "old").otherwise(F.col("row_hash")), "revision": F.col("slot"), "source_priority": F.when(F.dayofmonth("trading_date") % 2 == 0, 300).otherwise(400)}
    )
    return B.merge_bars(old, new, key).drop("event_id").withColumn("trading_date", day())


@query(
    "hot_pool",
    f"""{EVENTS}, q AS (SELECT symbol, arg_max(price_ticks, (event_time, event_id)) AS price FROM ticks GROUP BY symbol), n AS (SELECT ev.symbol, side, ticks, abs(ticks - price) AS distance, CASE strongest_stage WHEN 'ESTABLISHED' THEN 1 WHEN 'FOCUS' THEN 2 WHEN 'OBSERVING' THEN 3 ELSE 5 END AS rank FROM ev JOIN q USING (symbol) WHERE is_active
 UNION ALL SELECT symbol, NULL, NULL, NULL, 0 FROM q WHERE symbol LIKE '%7' UNION ALL SELECT symbol, NULL, NULL, NULL, 4 FROM q WHERE symbol LIKE 'U1%'),
g AS (SELECT symbol, min(rank) AS rank, count(ticks) AS levels, coalesce(string_agg(DISTINCT side, ',' ORDER BY side), '') AS sides, min(distance) AS distance, arg_min(ticks, (distance, ticks)) FILTER (ticks IS NOT NULL) AS nearest_ticks FROM n GROUP BY symbol)
SELECT *, row_number() OVER (ORDER BY rank, distance NULLS LAST, symbol) AS place, CAST(floor((row_number() OVER (ORDER BY rank, distance NULLS LAST, symbol) - 1) / 50) AS INTEGER) AS shard FROM g ORDER BY place LIMIT 300""",
)
def hot_pool(spark: SparkSession, folder: str) -> DataFrame:
    quotes = B.latest_quotes(A.ticks(spark, folder))
    return M.hot_pool(events(spark, folder), quotes, manual=quotes.filter("symbol like '%7'"), strategy=quotes.filter("symbol like 'U1%'"))


@query(
    "notification_cards",
    f"""{EVENTS}, l AS (SELECT event_key, symbol, 'OBSERVING' AS to_stage, observed_at AS moment FROM ev WHERE observed_at IS NOT NULL UNION ALL SELECT event_key, symbol, 'FOCUS', focused_at FROM ev WHERE focused_at IS NOT NULL
 UNION ALL SELECT event_key, symbol, 'ESTABLISHED', established_at FROM ev WHERE established_at IS NOT NULL UNION ALL SELECT event_key, symbol, 'INVALIDATED', break_eob FROM ev WHERE break_eob IS NOT NULL AND observed_at IS NOT NULL)
SELECT sha256(event_key || '|' || to_stage) AS card_id, event_key, symbol, to_stage, {stamp('moment', '"at"')}, CASE WHEN to_stage = 'ESTABLISHED' THEN 'critical' WHEN to_stage IN ('FOCUS', 'INVALIDATED') THEN 'warning' ELSE 'info' END AS severity FROM l""",
)
def notification_cards(spark: SparkSession, folder: str) -> DataFrame:
    return M.notifications(P.lifecycle(events(spark, folder))).withColumns(text("at"))


@query("retention", f"{HITS}, o AS (SELECT event_key, last_seen_at < TIMESTAMP '{CUTOFF}' AS old FROM ev) " + " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) FILTER (old) AS removed, count(*) FILTER (NOT old) AS kept FROM {t} JOIN o USING (event_key)" for n, t in (("events", "ev"), ("hits", "evidence"), ("lifecycle", "moves"))))
def retention(spark: SparkSession, folder: str) -> DataFrame:
    return M.retain(*replayed(spark, folder), cutoff())[3]


@query("source_reconciliation", f"{EVENTS} SELECT event_key, 'INVALIDATED' AS stage, 'SOURCE_RECONCILIATION' AS invalidation_reason FROM ev WHERE is_active AND ticks % 3 = 0")
def source_reconciliation(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return M.reconcile_day(e, e.filter("ticks % 3 <> 0")).select("event_key", "stage", "invalidation_reason")


@query("orphan_lifecycle", f"{EVENTS} SELECT event_key, symbol FROM ev WHERE ticks % 5 = 0")
def orphan_lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    e = events(spark, folder)
    return M.orphans(P.lifecycle(e), e.filter("ticks % 5 <> 0"), "event_key").filter("to_stage = 'DISCOVERED'").select("event_key", "symbol")


@query(
    "signal_ageing",
    f"WITH {SIGNALS} SELECT signal_id, CASE WHEN minutes >= 18 THEN 'expired' WHEN minutes >= 6 THEN 'weakened' ELSE status END AS aged_status FROM (SELECT *, date_diff('second', observed_at, CAST(trading_date AS TIMESTAMP) + INTERVAL 4 HOUR) // 60 AS minutes FROM sig)",
)
def signal_ageing(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.signals(spark, folder).withColumn("last_seen_at", F.col("observed_at"))
    now = F.timestamp_add("HOUR", F.lit(4), F.col("trading_date").cast("timestamp_ntz"))
    return S.age(rows, now).select("signal_id", "aged_status")


@query("signal_cards", f"WITH {SIGNALS} SELECT signal_id, c_name AS customer, strategy_code, score FROM sig JOIN orders ON o_orderkey = signal_id LEFT JOIN customer ON c_custkey = o_custkey")
def signal_cards(spark: SparkSession, folder: str) -> DataFrame:
    names = A.table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("customer"))
    owner = A.table(spark, folder, "orders").select(F.col("o_orderkey").alias("signal_id"), F.col("o_custkey").alias("c_custkey"))
    return A.signals(spark, folder).join(owner, "signal_id").join(names, "c_custkey", "left").select("signal_id", "customer", "strategy_code", "score")


_GATE = """t AS (SELECT event_id, user_id % 5 AS worker_id, date_trunc('day', ts) AS session_id, ts AS event_time, event_id AS arrival,
         (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 7 AS worker_sequence FROM events),
g AS (SELECT *, max(worker_sequence) OVER (PARTITION BY worker_id, session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, date_diff('second', event_time, session_id + INTERVAL 12 HOUR) AS late FROM t)"""


@query("tick_gate", f"WITH {_GATE} SELECT event_id, worker_sequence::BIGINT AS worker_sequence, CASE WHEN worker_sequence <= seen THEN 'DUPLICATE' WHEN NOT (late BETWEEN -30 AND 21600) THEN 'EXPIRED' ELSE 'ACCEPTED' END AS verdict FROM g")
def tick_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ticks of five workers, a session a day, their times in whole seconds, seen at noon: what a high-water mark of their
    sequences lets through."""
    from tidebar.streaming.state import gate

    e = A.table(spark, folder, "events")
    sequence = F.floor((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 7).cast("long")
    rows = e.select("event_id", (F.col("user_id") % 5).alias("worker_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("session_id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("event_time"), F.col("event_id").alias("arrival"), sequence.alias("worker_sequence"))
    return gate(rows, F.col("session_id") + F.expr("INTERVAL 12 HOURS"), max_age=21600).select("event_id", "worker_sequence", "verdict")
