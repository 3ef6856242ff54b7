"""Registered queries over daily bars and strategy signals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import daily as D
from tidebar.operators import nextday as N
from tidebar.operators import signals as S
from tidebar.plans.market import EVENTS, QUERIES, SQL, day, events, intraday, query, stamp, text
from tidebar.operators.universe import search
from tidebar.sources import adapters as A

__all__ = ["QUERIES", "SQL"]

DAILY = """daily AS (
  SELECT 'S' || CAST(l_suppkey % 10 AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS trading_date, arg_min(p, (l_orderkey, l_linenumber, l_partkey, p, l_quantity)) AS open_ticks, max(p) AS high_ticks, min(p) AS low_ticks,
         arg_max(p, (l_orderkey, l_linenumber, l_partkey, p, l_quantity)) AS close_ticks, CAST(sum(l_quantity) AS BIGINT) AS volume, sum(p)::BIGINT AS amount_ticks
  FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS p FROM lineitem) GROUP BY 1, 2)"""
SIGNALS = """sig AS (
  SELECT 'C' || CAST(o_custkey % 50 AS VARCHAR) AS symbol, o_orderpriority AS strategy_code, CAST(o_orderdate AS DATE) AS trading_date, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 14400 AS INTEGER)) AS observed_at,
         CAST(60 + CAST(round(o_totalprice * 100) AS BIGINT) % 40 AS INTEGER) AS score, CASE o_orderstatus WHEN 'F' THEN 'expired' WHEN 'P' THEN 'weakened' ELSE 'active' END AS status, o_orderkey AS signal_id FROM orders)"""
W = "PARTITION BY symbol ORDER BY trading_date"
DATE = "strftime(trading_date, '%Y-%m-%d') AS trading_date"


def mean(n: int, skip: int = 0, column: str = "close_ticks") -> str:
    frame = f"OVER ({W.replace('trading_date', 'd')} ROWS BETWEEN {n - 1 + skip} PRECEDING AND {skip} PRECEDING)"
    return f"CASE WHEN count({column}) {frame} >= {n} THEN avg({column}) {frame} ELSE 0 END"


def percent(value: str, base: str) -> str:
    return f"CASE WHEN {base} = 0 THEN 0 ELSE ({value} - {base}) / ({base})::DOUBLE * 100 END"


BASE = f"WITH {DAILY}, x AS (SELECT *, trading_date AS d FROM daily)"
AVERAGES = f"""{BASE}, a AS (SELECT *, {', '.join(f'{mean(n)} AS ma{n}' for n in (5, 10, 20, 30, 60))}, {mean(20, 1)} AS ma20_before FROM x)"""


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


@query("daily_bars", f"{BASE} SELECT symbol, {DATE}, open_ticks, high_ticks, low_ticks, close_ticks, volume, amount_ticks FROM x")
def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    return A.daily_bars(spark, folder).withColumn("trading_date", day())


@query("weekly_bars", f"{BASE} SELECT symbol, strftime(date_trunc('week', d), '%Y-%m-%d') AS week, arg_min(open_ticks, d) AS open_ticks, max(high_ticks) AS high_ticks, min(low_ticks) AS low_ticks, arg_max(close_ticks, d) AS close_ticks, sum(volume)::BIGINT AS volume, count(*) AS days FROM x GROUP BY symbol, date_trunc('week', d)")
def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    return B.weekly(A.daily_bars(spark, folder)).withColumn("week", day("week"))


@query(
    "moving_averages",
    f"{AVERAGES} SELECT symbol, {DATE}, {', '.join(f'round(ma{n}, 4) AS ma{n}' for n in (5, 10, 20, 30, 60))}, round({percent('ma20', 'ma20_before')}, 4) AS ma20_slope, round({percent('ma20', 'ma60')}, 4) AS trend_strength FROM a",
)
def moving_averages(spark: SparkSession, folder: str) -> DataFrame:
    names = [*[f"ma{n}" for n in (5, 10, 20, 30, 60)], "ma20_slope", "trend_strength"]
    return rounded(D.moving_averages(A.daily_bars(spark, folder)), *names).select("symbol", day(), *names)


@query(
    "trend_gate",
    f"""{AVERAGES}, g AS (SELECT symbol, d, close_ticks / lag(close_ticks, 20) OVER ({W.replace('trading_date', 'd')})::DOUBLE - 1 AS return_20,
  close_ticks / max(high_ticks) OVER ({W.replace('trading_date', 'd')} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)::DOUBLE - 1 AS drawdown_60, ma10 < ma20 AND ma20 < lag(ma20, 5) OVER ({W.replace('trading_date', 'd')}) AS falling FROM a)
SELECT symbol, strftime(d, '%Y-%m-%d') AS trading_date, round(return_20, 4) AS return_20, round(drawdown_60, 4) AS drawdown_60,
 (coalesce(return_20 <= -0.08, false)::INT + coalesce(drawdown_60 <= -0.15, false)::INT + coalesce(falling, false)::INT) >= 2 AS gate FROM g""",
)
def trend_gate(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.trend_gate(A.daily_bars(spark, folder)), "return_20", "drawdown_60").select("symbol", day(), "return_20", "drawdown_60", "gate")


@query(
    "pullback_volume",
    f"""{BASE}, p AS (SELECT symbol, trading_date, count(*) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS n, avg(volume) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS new,
  avg(volume) OVER (w ROWS BETWEEN 14 PRECEDING AND 5 PRECEDING) AS old FROM daily WINDOW w AS ({W})) SELECT symbol, {DATE}, round(CASE WHEN n >= 15 AND old > 0 THEN new / old ELSE 0 END, 4) AS pullback_volume_ratio FROM p""",
)
def pullback_volume(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.pullback_volume(A.daily_bars(spark, folder)), "pullback_volume_ratio").select("symbol", day(), "pullback_volume_ratio")


@query(
    "relative_strength",
    f"""{AVERAGES}, c AS (SELECT *, lag(close_ticks) OVER w AS pre_close, lag(close_ticks, 4) OVER w AS four FROM a WINDOW w AS ({W.replace('trading_date', 'd')})), p AS (SELECT *, {percent('close_ticks', 'coalesce(pre_close, 0)')} AS change FROM c),
m AS (SELECT d, avg(change) AS market_change FROM p WHERE pre_close > 0 GROUP BY d)
SELECT symbol, {DATE}, round(CASE WHEN four IS NULL THEN 0 ELSE {percent('close_ticks', 'four')} END, 4) AS five_day_return, round(coalesce(least(CASE WHEN ma20 > 0 THEN ma20 END, CASE WHEN ma30 > 0 THEN ma30 END), 0), 4) AS support,
 round(change - coalesce(market_change, 0), 4) AS relative_strength FROM p LEFT JOIN m USING (d)""",
)
def relative_strength(spark: SparkSession, folder: str) -> DataFrame:
    names = ["five_day_return", "support", "relative_strength"]
    return rounded(D.relative_strength(A.daily_bars(spark, folder)), *names).select("symbol", day(), *names)


@query(
    "weekly_platform",
    f"""{BASE}, k AS (SELECT symbol, date_trunc('week', d) AS week, max(high_ticks) AS h, min(low_ticks) AS l FROM x GROUP BY ALL), p AS (SELECT symbol, week, count(*) OVER b AS n, max(h) OVER a AS hi, min(l) OVER a AS lo, max(h) OVER b AS hi12, min(l) OVER b AS lo12,
 list(h) OVER a AS hs FROM k WINDOW a AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY week ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT symbol, strftime(week, '%Y-%m-%d') AS week, CASE WHEN n >= 12 THEN hi ELSE 0 END AS platform_high, CASE WHEN n >= 12 THEN lo ELSE 0 END AS platform_low, round(CASE WHEN n >= 12 THEN {percent('hi', 'lo')} ELSE 0 END, 4) AS range_24,
 round(CASE WHEN n >= 12 THEN {percent('hi12', 'lo12')} ELSE 0 END, 4) AS range_12, CASE WHEN n >= 12 THEN len(list_filter(hs, lambda q: q >= hi * 0.97)) ELSE 0 END AS touches FROM p""",
)
def weekly_platform(spark: SparkSession, folder: str) -> DataFrame:
    rows = rounded(D.weekly_platform(B.weekly(A.daily_bars(spark, folder))), "range_24", "range_12")
    return rows.select("symbol", day("week"), "platform_high", "platform_low", "range_24", "range_12", "touches")


AHEAD = f"""ahead AS (SELECT symbol, trading_date, close_ticks AS c, lead(close_ticks, 1) OVER w AS c1, lead(close_ticks, 3) OVER w AS c3, lead(close_ticks, 5) OVER w AS c5, max(high_ticks) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS hi,
 min(low_ticks) OVER (w ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS lo, first_value(close_ticks) OVER (PARTITION BY symbol ORDER BY trading_date RANGE BETWEEN INTERVAL 7 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS cw FROM daily WINDOW w AS ({W})),
outcome AS (SELECT symbol, trading_date, c, {', '.join(f'{percent(f"c{n}", "c")} AS d{n}' for n in (1, 3, 5))}, {percent('cw', 'c')} AS w1, {percent('hi', 'c')} AS mfe5, {percent('lo', 'c')} AS mae5 FROM ahead)"""
_OUTCOMES = ["d1", "d3", "d5", "w1", "mfe5", "mae5"]


@query("forward_outcomes", f"{BASE}, {AHEAD} SELECT symbol, {DATE}, {', '.join(f'round({n}, 4) AS {n}' for n in _OUTCOMES)} FROM outcome")
def forward_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Every daily bar as a signal."""
    bars = A.daily_bars(spark, folder)
    return rounded(D.forward_outcomes(bars.select("symbol", "trading_date"), bars), *_OUTCOMES).select("symbol", day(), *_OUTCOMES)


def _wave_sql() -> str:
    ema = lambda values, n: f"list_reduce({values}, lambda a, x: a * {n - 1}.0 / {n + 1} + x * 2.0 / {n + 1})"
    wilder = lambda values, e: f"list_reduce(list_concat([list_avg({values}[1:14])], {values}[15:len({values}) - {e}]), lambda a, x: (a * 13 + x) / 14)"
    rsi = lambda e: f"CASE WHEN {wilder('dn', e)} = 0 THEN 100 ELSE 100 - 100 / (1 + {wilder('up', e)} / {wilder('dn', e)}) END"
    hist = lambda e: f"(dif[n - {e}] - {ema(f'dif[1:n - {e}]', 9)}) * 2"
    ma = lambda k, skip=0: f"list_avg(c[n - {k + skip} + 1:n - {skip}])"
    tests = {
        "RSI_TURN": "list_min([r0, r1, r2, r3, r4]) <= 35 AND r0 > r1", "MACD_CONTRACTION": "h0 <= 0 AND h0 > h1 AND h1 > h2", "NO_NEW_LOW": "l[n] > list_min(l[n - 4:n - 1])",
        "BOTTOM_STRUCTURE": "q - p BETWEEN 5 AND 30 AND (l[q + 1] >= 1.005 * l[p + 1] OR (abs(l[q + 1] / l[p + 1] - 1) <= 0.03 AND h[n] >= list_max(h[p + 1:q + 1])))",
        "MA_RECOVERY": f"c[n] > {ma(10)} AND {ma(10)} >= {ma(10, 5)}", "SHORT_PRESSURE_MA5": f"c[n] > list_max(h[n - 10:n - 1]) AND c[n] > {ma(5)}", "VOLUME_CONFIRM": "list_avg(v[n - 5:n - 1]) > 0 AND v[n] >= 1.2 * list_avg(v[n - 5:n - 1])",
    }
    gates = ["c[n] / c[n - 20] - 1 <= -0.08", "c[n] / list_max(h[n - 59:n]) - 1 <= -0.15", f"{ma(10)} < {ma(20)} AND {ma(20)} < {ma(20, 5)}"]
    met = ", ".join(f"coalesce({t}, false) AS t_{k}" for k, t in tests.items())
    score = " + ".join(f"CASE WHEN t_{k} THEN {D.POINTS[k]} ELSE 0 END" for k in tests)
    names = ", ".join(f"CASE WHEN t_{k} THEN '{k}' END" for k in tests)
    return f"""{BASE}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM x), e AS (SELECT symbol, max(d) AS as_of FROM x GROUP BY symbol, date_trunc('month', d)),
w AS (SELECT e.symbol, as_of, count(*) AS n, list(b.close_ticks::DOUBLE ORDER BY b.d) AS c, list(b.high_ticks::DOUBLE ORDER BY b.d) AS h, list(b.low_ticks::DOUBLE ORDER BY b.d) AS l, list(b.volume::DOUBLE ORDER BY b.d) AS v
 FROM e JOIN k z ON z.symbol = e.symbol AND z.d = as_of JOIN k b ON b.symbol = e.symbol AND b.i BETWEEN z.i - {D.LOOK_BACK - 1} AND z.i GROUP BY ALL),
s AS (SELECT *, list_transform(range(2, n + 1), lambda i: greatest(c[i] - c[i - 1], 0)) AS up, list_transform(range(2, n + 1), lambda i: greatest(c[i - 1] - c[i], 0)) AS dn,
 list_transform(range(1, n + 1), lambda i: {ema('c[1:i]', 12)} - {ema('c[1:i]', 26)}) AS dif, list_filter(range(greatest(2, n - 45), n - 2), lambda i: l[i + 1] <= l[i] AND l[i + 1] <= l[i + 2] AND l[i + 1] <= l[i - 1] AND l[i + 1] <= l[i + 3]) AS lows FROM w WHERE n >= {D.LEAST_BARS}),
r AS (SELECT *, {', '.join(f'{rsi(i)} AS r{i}' for i in range(5))}, {', '.join(f'{hist(i)} AS h{i}' for i in range(3))}, CASE WHEN len(lows) >= 2 THEN lows[-2] END AS p, CASE WHEN len(lows) >= 2 THEN lows[-1] END AS q FROM s),
t AS (SELECT symbol, as_of, n, {' + '.join(f'coalesce({g}, false)::INT' for g in gates)} >= 2 AS gate, {met} FROM r),
o AS (SELECT symbol, as_of, n, gate, {score} AS score, concat_ws(',', {names}) AS matched FROM t)
SELECT symbol, strftime(as_of, '%Y-%m-%d') AS as_of, n, 'COMPLETED' AS status, gate, score, CASE WHEN gate AND score >= {D.STRONG} THEN 'STRONG' WHEN gate AND score >= {D.CANDIDATE} THEN 'CANDIDATE' ELSE 'NONE' END AS signal, matched FROM o
UNION ALL SELECT symbol, strftime(as_of, '%Y-%m-%d'), n, 'INSUFFICIENT_DATA', false, 0, 'NONE', '' FROM w WHERE n < {D.LEAST_BARS}"""


@query("wave_scores", _wave_sql())
def wave_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every symbol as of each month's last bar."""
    bars = A.daily_bars(spark, folder)
    jobs = bars.groupBy("symbol", F.trunc("trading_date", "month").alias("m")).agg(F.max("trading_date").alias("as_of")).drop("m")
    return D.wave_score(D.look_back(jobs, bars)).withColumn("as_of", day("as_of"))


@query("market_change", f"{BASE}, c AS (SELECT *, lag(close_ticks) OVER ({W.replace('trading_date', 'd')}) AS pre FROM x) SELECT {DATE}, count(*) AS symbols, round(avg((close_ticks - pre) / pre::DOUBLE * 100), 4) AS market_change FROM c WHERE pre > 0 GROUP BY c.trading_date")
def market_change(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(D.market_change(A.daily_bars(spark, folder)), "market_change").withColumn("trading_date", day())


@query(
    "signal_events",
    f"""WITH {SIGNALS}, l AS (SELECT *, lag(score) OVER (PARTITION BY symbol, strategy_code, trading_date ORDER BY observed_at, signal_id) AS before FROM sig)
SELECT signal_id, score, CASE WHEN before IS NULL THEN 'New' WHEN score >= before + 2 THEN 'Strengthened' ELSE 'Repeated' END AS event_type FROM l""",
)
def signal_events(spark: SparkSession, folder: str) -> DataFrame:
    return S.classify_signals(A.signals(spark, folder)).select("signal_id", "score", "event_type")


ROLLED = f"""WITH {SIGNALS}, one AS (SELECT symbol, trading_date, strategy_code, max(score) AS score, count(*) AS hits, arg_max(status, (observed_at, signal_id)) AS status, min(observed_at) AS f, max(observed_at) AS t FROM sig GROUP BY ALL),
r AS (SELECT symbol, trading_date, count(*) FILTER (status = 'active') AS active_strategies, count(*) AS strategies, sum(hits)::BIGINT AS hits, max(score) FILTER (status = 'active') AS best_score,
 arg_min(strategy_code, (-score, strategy_code)) FILTER (status = 'active') AS primary_strategy, max((status = 'weakened')::INT) AS weak, min(f) AS first_seen_at, max(t) AS last_seen_at FROM one GROUP BY ALL),
opp AS (SELECT * EXCLUDE weak, CASE WHEN (active_strategies >= 2 AND coalesce(best_score, 0) >= 85) OR coalesce(best_score, 0) >= 95 THEN 'focus' WHEN active_strategies >= 2 OR coalesce(best_score, 0) >= 90 THEN 'candidate' ELSE 'observe' END AS level,
 CASE WHEN active_strategies > 0 THEN 'active' WHEN weak = 1 THEN 'weakened' ELSE 'expired' END AS status FROM r)"""


@query("opportunities", f"{ROLLED} SELECT symbol, {DATE}, active_strategies, strategies, hits, best_score, primary_strategy, level, status, {stamp('first_seen_at')}, {stamp('last_seen_at')} FROM opp")
def opportunities(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.opportunities(A.signals(spark, folder))
    return rows.withColumns(text("first_seen_at", "last_seen_at") | {"trading_date": day()})


@query("opportunity_levels", f"{ROLLED} SELECT level, status, count(*) AS n, count(DISTINCT symbol) AS symbols FROM opp GROUP BY ALL")
def opportunity_levels(spark: SparkSession, folder: str) -> DataFrame:
    return S.opportunities(A.signals(spark, folder)).groupBy("level", "status").agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"))


@query(
    "first_crossings",
    f"""WITH {SIGNALS}, t AS (SELECT *, unnest([75, 80, 85, 90, 95]) AS threshold FROM sig)
SELECT symbol, strategy_code, {DATE}, threshold::INTEGER AS threshold, signal_id, score, {stamp('observed_at')} FROM t WHERE score >= threshold QUALIFY row_number() OVER (PARTITION BY symbol, strategy_code, t.trading_date, threshold ORDER BY t.observed_at, signal_id) = 1""",
)
def first_crossings(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.first_crossings(A.signals(spark, folder))
    return rows.withColumns(text("observed_at") | {"trading_date": day()})


SPLIT = f"""s AS (SELECT symbol, trading_date, 'mod' || CAST(c % 3 AS VARCHAR) AS strategy_code, CAST(75 + 5 * (c % 5) AS INTEGER) AS threshold, d1, d3, d5, w1, mfe5, mae5 FROM outcome),
n AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS k, count(*) OVER () AS total FROM (SELECT DISTINCT trading_date FROM s)),
g AS (SELECT s.*, CASE WHEN k <= total * 0.7 THEN 'train' ELSE 'validation' END AS segment FROM s JOIN n USING (trading_date)), b AS (SELECT * FROM g UNION ALL SELECT * REPLACE ('all' AS segment) FROM g),
cal AS (SELECT strategy_code, threshold, segment, {', '.join(f"count({h}) AS samples_{h}, avg(({h} > 0)::INT) AS win_rate_{h}, avg({h}) AS mean_{h}" for h in S.HORIZONS)}, avg(mfe5) AS mean_mfe5, avg(mae5) AS mean_mae5 FROM b GROUP BY ALL)"""
_MEANS = [*[f"{x}_{h}" for h in S.HORIZONS for x in ("win_rate", "mean")], "mean_mfe5", "mean_mae5"]


def _calibrated(spark: SparkSession, folder: str) -> DataFrame:
    bars = A.daily_bars(spark, folder)
    named = bars.select("symbol", "trading_date", F.concat(F.lit("mod"), (F.col("close_ticks") % 3).cast("string")).alias("strategy_code"), (75 + 5 * (F.col("close_ticks") % 5)).cast("int").alias("threshold"))
    return S.calibration(D.forward_outcomes(S.train_split(named), bars))


@query("calibration", f"{BASE}, {AHEAD}, {SPLIT} SELECT strategy_code, threshold, segment, {', '.join(f'samples_{h}' for h in S.HORIZONS)}, {', '.join(f'round({m}, 4) AS {m}' for m in _MEANS)} FROM cal")
def calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Every daily bar is a signal of a strategy and threshold by its close."""
    return rounded(_calibrated(spark, folder), *_MEANS)


@query(
    "recommendations",
    f"""{BASE}, {AHEAD}, {SPLIT}, p AS (SELECT t.strategy_code, t.threshold, round((t.mean_d3 + v.mean_d3) / 2 - abs(t.mean_d3 - v.mean_d3), 9) AS objective FROM cal t JOIN cal v ON v.strategy_code = t.strategy_code AND v.threshold = t.threshold
 WHERE t.segment = 'train' AND v.segment = 'validation' AND t.samples_d3 >= 20 AND v.samples_d3 >= 20 AND t.mean_d3 > 0 AND v.mean_d3 > 0 AND t.win_rate_d3 >= 0.5 AND v.win_rate_d3 >= 0.5)
SELECT strategy_code, threshold, round(objective, 4) AS objective FROM p QUALIFY row_number() OVER (PARTITION BY strategy_code ORDER BY p.objective DESC, threshold) = 1""",
)
def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(S.recommendations(_calibrated(spark, folder)), "objective")


VALIDATED = f"""{EVENTS}, cal AS (SELECT trading_date, lead(trading_date) OVER (ORDER BY trading_date) AS next_date FROM (SELECT DISTINCT trading_date FROM b5m)),
proof AS (SELECT d.symbol, d.trading_date, s.slot FROM (SELECT DISTINCT symbol, trading_date FROM ticks) d, (SELECT unnest(range(48))::INTEGER AS slot) s ANTI JOIN b5m ON b5m.symbol = d.symbol AND b5m.trading_date = d.trading_date AND b5m.slot = s.slot WHERE day(d.trading_date) % 3 <> 0),
cover AS (SELECT symbol, trading_date, count(*) FILTER (NOT bar) AS proven, count(*) = 48 AND count(DISTINCT slot) = 48 AS covered FROM (SELECT symbol, trading_date, slot, true AS bar FROM b5m UNION ALL SELECT *, false FROM proof) GROUP BY ALL),
e AS (SELECT ev.*, cal.next_date FROM ev LEFT JOIN cal ON cal.trading_date = CAST(established_at AS DATE) WHERE established_at IS NOT NULL),
q AS (SELECT e.event_key, count(*) AS bars, CASE WHEN any_value(side) = 'TOP' THEN max(high_ticks) ELSE min(low_ticks) END AS extreme_ticks,
  min(b.eob) FILTER ((side = 'TOP' AND high_ticks > ticks) OR (side = 'BOTTOM' AND low_ticks < ticks)) AS breached_at FROM e JOIN b5m b ON b.symbol = e.symbol AND b.trading_date = e.next_date AND b.eob <= TIMESTAMP '@' GROUP BY e.event_key),
v AS (SELECT e.*, coalesce(bars, 0) AS bars, coalesce(proven, 0) AS proven, extreme_ticks, CASE WHEN break_eob < CAST(next_date AS TIMESTAMP) + to_minutes(570) THEN 'NOT_APPLICABLE' WHEN breached_at IS NOT NULL THEN 'INVALIDATED' WHEN next_date IS NULL OR CAST(next_date AS TIMESTAMP) + to_minutes(900) > TIMESTAMP '@' THEN 'MONITORING'
  WHEN NOT coalesce(covered, false) THEN 'INCOMPLETE' WHEN bars IS NULL THEN 'NO_TRADE' ELSE 'PASSED' END AS validation, breached_at FROM e LEFT JOIN q USING (event_key) LEFT JOIN cover c ON c.symbol = e.symbol AND c.trading_date = e.next_date)"""
FAR, NOON = "2100-01-01 00:00:00", "2024-01-20 13:00:00"


def validated(spark: SparkSession, folder: str, as_of: str) -> DataFrame:
    """Slots without a bar are proven to be without trade on two days of three."""
    b5 = intraday(spark, folder)["5m"]
    proofs = B.missing_slots(A.ticks(spark, folder).select("symbol", "trading_date").distinct(), b5, "5m").filter(F.dayofmonth("trading_date") % 3 != 0)
    return N.validate(events(spark, folder), b5, N.next_trading_date(b5), F.lit(as_of).cast("timestamp_ntz"), proofs)


_VALIDATED = """SELECT event_key, symbol, side, ticks, strftime(next_date, '%Y-%m-%d') AS next_date, validation, bars, proven, extreme_ticks, strftime(CASE WHEN validation = 'INVALIDATED' THEN breached_at END, '%Y-%m-%d %H:%M:%S') AS breached_at FROM v"""


@query("next_day_validation", f"{VALIDATED.replace('@', FAR)} {_VALIDATED}")
def next_day_validation(spark: SparkSession, folder: str) -> DataFrame:
    return validated(spark, folder, FAR).drop("breach_ticks").withColumns(text("breached_at") | {"next_date": day("next_date")})


@query("next_day_monitor", f"{VALIDATED.replace('@', NOON)} {_VALIDATED}")
def next_day_monitor(spark: SparkSession, folder: str) -> DataFrame:
    """The same in the middle of a day: what has broken is known, the rest of that day is watched."""
    return validated(spark, folder, NOON).drop("breach_ticks").withColumns(text("breached_at") | {"next_date": day("next_date")})


@query(
    "validation_summary",
    f"""{VALIDATED.replace('@', NOON)}, g AS (SELECT next_date, count(*) AS total, {', '.join(f"count(*) FILTER (validation = '{v}') AS {n}" for v, n in (('INVALIDATED', 'invalidated'), ('PASSED', 'passed'), ('NO_TRADE', 'no_trade'), ('NOT_APPLICABLE', 'not_applicable'), ('INCOMPLETE', 'incomplete'), ('MONITORING', 'remaining')))} FROM v GROUP BY next_date)
SELECT * REPLACE (strftime(next_date, '%Y-%m-%d') AS next_date), CASE WHEN remaining > 0 THEN 'RUNNING' WHEN incomplete > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM g""",
)
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return N.validation_summary(validated(spark, folder, NOON), ["next_date"]).withColumn("next_date", day("next_date"))


@query(
    "validation_applied",
    f"""{VALIDATED.replace('@', FAR)}, r AS (SELECT ev.event_key, ev.symbol, CASE WHEN ev.ticks % 2 = 0 THEN NULL ELSE ev.break_eob END AS old_break, ev.ticks % 2 = 0 OR ev.is_active AS was_active, v.side, v.breached_at FROM ev LEFT JOIN v ON v.event_key = ev.event_key AND v.validation = 'INVALIDATED'),
c AS (SELECT *, breached_at IS NOT NULL AND (old_break IS NULL OR breached_at < old_break) AS moved FROM r)
SELECT event_key, was_active AND NOT moved AS is_active, CASE WHEN moved THEN CASE WHEN side = 'TOP' THEN 'NEXT_DAY_TOP_PRICE_BREAK' ELSE 'NEXT_DAY_BOTTOM_PRICE_BREAK' END END AS invalidation_reason, {stamp('CASE WHEN moved THEN breached_at ELSE old_break END', 'break_eob')}, moved AS has_pre_image FROM c""",
)
def validation_applied(spark: SparkSession, folder: str) -> DataFrame:
    """The validation applied to events of which half had not been known to break."""
    even = F.col("ticks") % 2 == 0
    stored = events(spark, folder).withColumns({"break_eob": F.when(even, None).otherwise(F.col("break_eob")), "is_active": even | F.col("is_active")})
    after, before, moves = N.apply_validation(stored, validated(spark, folder, FAR))
    marked = before.select("event_key", F.lit(True).alias("pre")).join(moves.select("event_key"), "event_key")
    return after.join(marked, "event_key", "left").select("event_key", "is_active", "invalidation_reason", text("break_eob")["break_eob"].alias("break_eob"), F.coalesce("pre", F.lit(False)).alias("has_pre_image"))


@query("dataset_counts", " UNION ALL ".join(f"SELECT '{t}' AS dataset, count(*) AS n FROM {t}" for t in ("events", "lineitem", "orders", "supplier", "customer", "nation", "region", "part")))
def dataset_counts(spark: SparkSession, folder: str) -> DataFrame:
    from functools import reduce

    names = ("events", "lineitem", "orders", "supplier", "customer", "nation", "region", "part")
    return reduce(DataFrame.unionByName, [A.table(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("dataset"), "n") for t in names])


@query(
    "instrument_search",
    "SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, s_name AS name, s_acctbal >= 0 AS is_eligible FROM supplier WHERE contains(s_name, '1') OR contains('S' || CAST(s_suppkey AS VARCHAR), '1') ORDER BY (s_acctbal >= 0) DESC, ('S' || CAST(s_suppkey AS VARCHAR)) = 'S1' DESC, symbol LIMIT 50",
)
def instrument_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(A.instruments(spark, folder), "1", exact="S1").select("symbol", "name", "is_eligible")
