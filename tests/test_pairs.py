"""The set form of pair events against the sequential rules, bar after bar."""

import random
from datetime import date, datetime, timedelta

import pytest

from tidebar.operators import pairs as P

RANK = {"5m": 0, "30m": 1, "60m": 2, "1d": 3}


def clock(minute, end):
    return 570 + minute if (minute <= 120 if end else minute < 120) else 660 + minute


def bars_of(seed, days=3):
    rng = random.Random(seed)
    rows, base = [], rng.randint(1000, 1400)
    for d in range(days):
        day = date(2024, 1, 2) + timedelta(days=d)
        slots = {}
        for slot in range(48):
            if rng.random() < 0.85:
                a, b = sorted(base + rng.randint(-30, 30) for _ in range(2))
                slots[slot] = (b, a)
        for f, size in (("5m", 1), ("30m", 6), ("60m", 12), ("1d", 48)):
            for k in range(48 // size):
                part = [slots[s] for s in range(k * size, (k + 1) * size) if s in slots]
                if part:
                    high = max(p[0] for p in part) + (1 if f != "5m" and rng.random() < 0.05 else 0)
                    eob = datetime(day.year, day.month, day.day) + timedelta(minutes=clock((k + 1) * size * 5, True))
                    rows.append(("X", day, f, eob, high, min(p[1] for p in part)))
    return rows


def pair(t):
    return t > 0 and (t % 100) % 11 == 0


def sequential(rows):
    active, done = {}, []
    for symbol, _, f, eob, high, low in sorted(rows, key=lambda r: (r[3], RANK[r[2]])):
        for side, t in (("TOP", high), ("BOTTOM", low)):
            if f == "5m":
                for key in [k for k in active if k[0] == symbol and k[1] == side and (t > k[2] if side == "TOP" else t < k[2])]:
                    e = active.pop(key)
                    e["break_eob"], e["break_ticks"] = eob, t
                    done.append(e)
            if not pair(t):
                continue
            key = (symbol, side, t)
            if f == "5m":
                e = active.setdefault(key, {"key": key, "discovered_at": eob, "hits": 0, "o": None, "f": None, "e": None, "break_eob": None, "break_ticks": None})
                e["hits"] += 1
            elif key in active:
                e = active[key]
                if f == "30m" and e["o"] is None:
                    e["o"] = eob
                elif f == "60m" and e["o"] is not None and e["f"] is None:
                    e["f"] = eob
                elif f == "1d" and e["f"] is not None and e["e"] is None:
                    e["e"] = eob
    return done + list(active.values())


@pytest.mark.parametrize("seed", range(2))
def test_replay_equals_sequential_rules(spark, seed):
    rows = [r for s in range(4) for r in [("X%d" % s, *x[1:]) for x in bars_of(seed * 10 + s)]]
    df = spark.createDataFrame(rows, "symbol string, trading_date date, frequency string, eob timestamp_ntz, high_ticks long, low_ticks long").cache()
    got = P.replay({f: df.filter(df.frequency == f) for f in RANK})
    mine = sorted((r.symbol, r.side, r.ticks, r.discovered_at, r.hits_5m, r.observed_at, r.focused_at, r.established_at, r.break_eob, r.break_ticks) for r in got.collect())
    theirs = sorted((*e["key"], e["discovered_at"], e["hits"], e["o"], e["f"], e["e"], e["break_eob"], e["break_ticks"]) for e in sequential(rows))
    assert [tuple(map(str, r)) for r in mine] == [tuple(map(str, r)) for r in theirs]
    five = df.filter("frequency = '5m'")
    got = spark.createDataFrame(got.collect(), got.schema)
    broken = P.with_breaks(P.pair_hits(five), five)
    hits = P.evidence(got, spark.createDataFrame(broken.collect(), broken.schema))
    assert all(r.n == 0 for r in P.invariants(got, hits, P.lifecycle(got)).collect())
    counters = {r.event_key: (r.candidates, r.promotions) for r in P.hit_counters(hits).collect()}
    assert counters == {r.event_key: (r.hits_5m, r.promotions) for r in got.collect()}


def test_pair_kinds(spark):
    df = spark.createDataFrame([(t,) for t in (0, -11, 1000, 1011, 1001, 1099, 1100, 22)], "t long")
    got = {r.t: r.k for r in df.select("t", P.pair_kind(df.t).alias("k")).collect()}
    assert got == {0: None, -11: None, 1000: "ROUND_00", 1011: "DOUBLE_DIGIT", 1001: None, 1099: "DOUBLE_DIGIT", 1100: "ROUND_00", 22: "DOUBLE_DIGIT"}


def test_equal_price_never_breaks(spark):
    day = date(2024, 1, 2)
    at = lambda m: datetime(2024, 1, 2, 9, 30) + timedelta(minutes=m)
    rows = [("A", day, "5m", at(5), 1011, 1000), ("A", day, "5m", at(10), 1011, 1005), ("A", day, "5m", at(15), 1012, 1000)]
    df = spark.createDataFrame(rows, "symbol string, trading_date date, frequency string, eob timestamp_ntz, high_ticks long, low_ticks long")
    e = {(r.side, r.ticks): r for r in P.break_groups(P.with_breaks(P.pair_hits(df), df)).collect()}
    assert e["TOP", 1011].break_eob == at(15) and e["TOP", 1011].hits_5m == 2
    assert e["BOTTOM", 1000].break_eob is None and e["BOTTOM", 1000].hits_5m == 2
