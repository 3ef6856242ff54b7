from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidebar.functions.session import session_minute
from tidebar.operators import bars as B
from tidebar.operators import daily as D
from tidebar.operators import nextday as N


def test_session_minute_edges(spark):
    times = {"09:29:59": None, "09:30:00": 0, "11:29:59": 119, "11:30:00": 119, "12:00:00": None, "13:00:00": 120, "15:00:00": 239, "15:00:01": None}
    df = spark.createDataFrame([(datetime.fromisoformat(f"2024-01-02 {t}"), t) for t in times], "ts timestamp_ntz, t string")
    assert {r.t: r.m for r in df.select("t", session_minute(F.col("ts")).alias("m")).collect()} == times


def test_validity_and_merge(spark):
    cols = "k int, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, amount_ticks long"
    df = spark.createDataFrame([(1, 5, 9, 4, 6, 1, 1), (2, 5, 4, 4, 6, 1, 1), (3, 5, 9, 4, 6, -1, 1), (4, None, 9, 4, 6, 1, 1)], cols)
    ok, bad = B.split_valid(df)
    assert [r.k for r in ok.collect()] == [1] and sorted(r.k for r in bad.collect()) == [2, 3, 4]
    stored = spark.createDataFrame([(1, "a", 0, 300), (2, "b", 3, 300), (3, "c", 1, 400)], "k int, row_hash string, revision int, source_priority int")
    incoming = spark.createDataFrame([(1, "a", 300), (2, "x", 300), (3, "y", 300), (4, "n", 300)], "k int, row_hash string, source_priority int")
    got = {r.k: (r.row_hash, r.revision, r.event_type, r.event_id is not None) for r in B.merge_bars(stored, incoming, ["k"]).collect()}
    assert got == {1: ("a", 0, None, False), 2: ("x", 4, "BarRevised", True), 3: ("c", 1, None, False), 4: ("n", 0, "BarClosed", True)}


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, row_hash string")
    one, conflict = B.dedupe_conflicts(df, ["k"])
    assert [(r.k, r.copies) for r in one.collect()] == [(1, 2)] and [r.k for r in conflict.collect()] == [2]


def wave_rows(breakout=False, n=120):
    out = []
    for i in range(n):
        c = 20 - 0.07 * i + (0.18 * (i - 111) if i >= 112 else 0)
        o, h, low = c + 0.10, c + 0.35, c - 0.30
        if breakout and i == n - 1:
            o, h, low, c = 13.20, 14.20, 13.10, 14.00
        out.append(("A", date(2026, 1, 1) + timedelta(days=i), *[round(x * 100) for x in (o, h, low, c)], 1000 + 10 * i))
    return out


COLS = "symbol string, trading_date date, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long"


def score(spark, rows):
    df = spark.createDataFrame(rows, COLS)
    return D.wave_score(D.look_back(df.groupBy("symbol").agg(F.max("trading_date").alias("as_of")), df)).first()


def test_wave_score(spark):
    full, broken, short = (score(spark, r) for r in (wave_rows(), wave_rows(True), wave_rows(n=59)))
    assert full.status == "COMPLETED" and full.n == 120 and full.gate and sum(D.POINTS.values()) == 100
    assert "SHORT_PRESSURE_MA5" not in full.matched and "SHORT_PRESSURE_MA5" in broken.matched
    assert (short.status, short.signal, short.score) == ("INSUFFICIENT_DATA", "NONE", 0)


def test_rsi_and_macd_against_loops(spark):
    rows = wave_rows()
    c = [r[5] / 1.0 for r in rows]
    df = spark.createDataFrame([(c,)], "c array<double>")
    got = df.select(D.rsi(F.col("c")).alias("r"), D.macd_histogram(D.macd_dif(F.col("c"))).alias("m")).first()
    d = [b - a for a, b in zip(c, c[1:])]
    u, v = sum(max(x, 0) for x in d[:14]) / 14, sum(max(-x, 0) for x in d[:14]) / 14
    want = [100 - 100 / (1 + u / v) if v else 100.0]
    for x in d[14:]:
        u, v = (u * 13 + max(x, 0)) / 14, (v * 13 + max(-x, 0)) / 14
        want.append(100 - 100 / (1 + u / v) if v else 100.0)
    assert max(abs(a - b) for a, b in zip(got.r, want, strict=True)) < 1e-9

    def ema(x, n):
        out = [x[0]]
        for y in x[1:]:
            out.append(out[-1] * (1 - 2 / (n + 1)) + y * 2 / (n + 1))
        return out

    dif = [a - b for a, b in zip(ema(c, 12), ema(c, 26))]
    assert max(abs(2 * (a - b) - m) for a, b, m in zip(dif, ema(dif, 9), got.m, strict=True)) < 1e-9


def test_next_day(spark):
    day = datetime(2026, 8, 17)
    nxt = day + timedelta(days=1)
    event = ("e", "A", "TOP", 1200, day + timedelta(hours=15), None)
    e = spark.createDataFrame([event], "event_key string, symbol string, side string, ticks long, established_at timestamp_ntz, break_eob timestamp_ntz")
    cal = spark.createDataFrame([(day.date(), nxt.date())], "trading_date date, next_date date")

    def run(highs, proven=48, as_of="2100-01-01 00:00:00"):
        rows = [("A", nxt.date(), i, nxt + timedelta(minutes=575 + 5 * i), h, 1000) for i, h in enumerate(highs)]
        b = spark.createDataFrame(rows, "symbol string, trading_date date, slot int, eob timestamp_ntz, high_ticks long, low_ticks long")
        proofs = spark.createDataFrame([("A", nxt.date(), i) for i in range(len(highs), proven)], "symbol string, trading_date date, slot int")
        return N.validate(e, b, cal, F.lit(as_of).cast("timestamp_ntz"), proofs).first()

    hit = run([1200] * 7 + [1201] + [1200] * 16)
    assert hit.validation == "INVALIDATED" and hit.breach_ticks == 1201 and hit.breached_at == nxt + timedelta(minutes=575 + 35)
    assert run([1200] * 24).validation == "PASSED" and run([]).validation == "NO_TRADE"
    assert run([1200] * 24, 47).validation == run([], 0).validation == "INCOMPLETE" and run([1201], 1).validation == "INVALIDATED"
    assert run([1200] * 24, as_of="2026-08-18 14:59:00").validation == "MONITORING"
