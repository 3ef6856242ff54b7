from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebar import catalogue
from tidebar.operators import bars as B
from tidebar.operators import daily as D
from tidebar.operators import intraday as I
from tidebar.operators import maintain as M
from tidebar.operators import nextday as N
from tidebar.operators import pairs as P
from tidebar.operators import recovery as R
from tidebar.operators import surface as Q
from tidebar.plans import market
from tidebar.sources import adapters as A
from tidebar.sources import store

FOLDER = "/root/testdata/sf0.001"


def test_ranges():
    assert Q.resolve_range(None, None, date(2024, 3, 1)) == (date(2024, 1, 2), date(2024, 3, 2))
    assert Q.resolve_range(date(2024, 1, 1), date(2024, 12, 31), date(2025, 1, 1)) == (date(2024, 1, 1), date(2025, 1, 1))
    for first, last in ((date(2024, 1, 2), date(2024, 1, 1)), (date(2023, 1, 1), date(2024, 1, 2))):
        with pytest.raises(ValueError):
            Q.resolve_range(first, last, date(2025, 1, 1))


def test_the_replay_has_no_faults(spark):
    rows = P.invariants(*market.replayed(spark, FOLDER)).collect()
    assert len(rows) == 13 and all(r.n == 0 for r in rows)


def test_roots_are_required(spark):
    e = market.events(spark, FOLDER)
    assert Q.require_root(e) is e
    with pytest.raises(ValueError):
        Q.require_root(e.withColumn("discovered_at", F.when(F.col("ticks") % 2 == 0, F.col("discovered_at"))))


def test_event_detail(spark):
    e, hits, moves = market.replayed(spark, FOLDER)
    key = e.filter("promotions = 3").agg(F.min("event_key")).first()[0]
    own, page, steps = Q.event_detail(e, hits, moves, key, 1, 3)
    assert [r.event_key for r in own.collect()] == [key]
    eobs = [r.eob for r in page.collect()]
    assert eobs == sorted(eobs, reverse=True) and len(eobs) == 3
    times = [r["at"] for r in steps.collect()]
    assert times == sorted(times) and len(times) >= 4


def test_breaks_over_days_and_months(spark):
    """The first bar strictly beyond, in the day, later in the month, months later, or never, against a loop."""
    import random

    rng = random.Random(5)
    rows = []
    for symbol in "AB":
        for month in (1, 2, 3, 7):
            for day in (1, 2, 15, 28):
                for slot in range(3):
                    low = 1000 + rng.randrange(0, 60)
                    rows.append((symbol, date(2024, month, day), datetime(2024, month, day, 10, 5 * slot), low + rng.randrange(0, 60), low))
    bars = spark.createDataFrame(rows, "symbol string, trading_date date, eob timestamp_ntz, high_ticks long, low_ticks long").withColumn("frequency", F.lit("5m"))
    hits = bars.select("symbol", "trading_date", "eob", F.inline(F.array(F.struct(F.lit("TOP").alias("side"), F.col("high_ticks").alias("ticks")), F.struct(F.lit("BOTTOM").alias("side"), F.col("low_ticks").alias("ticks")))))
    found = P.with_breaks(hits, bars).collect()
    assert len(found) == 2 * len(rows)
    for r in found:
        later = [(eob, h if r.side == "TOP" else low) for s, _, eob, h, low in sorted(rows, key=lambda x: x[2]) if s == r.symbol and eob > r.eob and (h > r.ticks if r.side == "TOP" else low < r.ticks)]
        assert (r.break_eob, r.break_ticks) == (later[0] if later else (None, None))
    assert len({r.break_eob is None for r in found}) == 2


def test_validation_needs_a_covered_day(spark):
    e = market.events(spark, FOLDER).filter("established_at is not null")
    five = market.intraday(spark, FOLDER)["5m"]
    far = F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")
    cal = N.next_trading_date(five)
    open_ = {r.validation for r in N.validate(e, five, cal, far).collect()}
    proofs = B.missing_slots(A.ticks(spark, FOLDER).select("symbol", "trading_date").distinct(), five, "5m")
    whole = {r.validation for r in N.validate(e, five, cal, far, proofs).collect()}
    assert "PASSED" not in open_ and "INCOMPLETE" in open_ and "INCOMPLETE" not in whole - {"NO_TRADE"} or "INCOMPLETE" in whole
    double = five.select("symbol", "trading_date", "slot").unionByName(proofs.select("symbol", "trading_date", "slot"))
    assert not N.covered_days(five, double).filter("covered").count()


def test_published_limits_and_branches(spark):
    day = dict(symbol="S", trading_date=date(2024, 1, 2), amount=9e7, bars=20, price=102.0, vwap=101.0, from_open=1.0, change=3.0, pullback=1.0, run_above=3, acceleration=1.6, recent3=1.2, volume_sustained=True, return_5=0.4, platform_breakout=0.5, gap=1.0, growth=False, above_vwap=1.0, restart=False)
    rows = [day, day | {"pullback": 0.4, "run_above": 2}, day | {"symbol": "T", "pullback": 0.9, "run_above": 2, "acceleration": 1.4, "platform_breakout": 0.0}, day | {"symbol": "U", "amount": 7.9e7}]
    rows += [day | {"symbol": "V", "gap": -1.5, "from_open": 2.5, "pullback": 1.8, "run_above": 1, "restart": True}, day | {"symbol": "W", "gap": -3.0, "from_open": 2.5, "run_above": 1}, day | {"symbol": "X", "gap": -3.0, "from_open": 2.5, "growth": True, "run_above": 1}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows[:1] + rows[2:]], list(day))
    got = {(r.symbol, r.rule): r.action for r in I.decisions(I.evaluate(df)).collect()}
    one, two = "vwap-volume-resonance", "gap-recovery-restart"
    assert [got[s, one] for s in "STU"] == ["CONFIRM", "CANDIDATE", "NONE"]
    assert [got[s, two] for s in "SVWX"] == ["NONE", "CONFIRM", "NONE", "CANDIDATE"]


def test_decline_wave_exits(spark):
    bar = lambda h, low, c: (date(2024, 1, 1), 0, h, low, c, 1)
    kind = "k string, price double, bars array<struct<trading_date:date,open_ticks:int,high_ticks:int,low_ticks:int,close_ticks:int,volume:int>>"
    flat = [bar(100, 95, 98)] * 140
    fall = flat[:20] + [bar(200, 190, 195)] + [bar(150 - i, 140 - i, 145 - i) for i in range(60)] + [bar(100 + i, 90 + i, 95 + i) for i in range(30)] + [bar(115 - i, 105 - i, 110 - i) for i in range(15)] + [bar(105, 95, 104)] * 14
    late = flat[:60] + [bar(200, 190, 195)] + [bar(150, 140 - i, 145) for i in range(79)]
    rows = {r.k: r for r in D.decline_wave(spark.createDataFrame([("flat", 100.0, flat), ("fall", 130.0, fall), ("late", 130.0, late), ("short", 1.0, flat[:119]), ("none", 1.0, None)], kind)).collect()}
    assert all(rows[k].decline == 0 and not rows[k].second_bottom for k in ("short", "none"))
    f = rows["fall"]
    assert f.decline == pytest.approx((200 - 81) / 2) and f.rebound == pytest.approx((129 - 81) / 81 * 100) and f.second_bottom and f.breaks_trend
    assert rows["late"].decline == pytest.approx((62 - 200) / 2) and rows["late"].rebound == 0
    assert rows["flat"].rebound != 0 and rows["flat"].decline == pytest.approx(5)


def test_stored_tables(spark, tmp_path):
    source, calls = str(tmp_path / "in"), []
    spark.range(5).write.parquet(source)

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    assert store.kept(spark, "t", [source], build).count() == 5 and store.kept(spark, "t", [source], build).count() == 5 and len(calls) == 1
    spark.range(7).write.mode("append").parquet(source)
    assert store.kept(spark, "t", [source], build).count() == 12 and len(calls) == 2
    # days that a batch has are replaced, others stay
    path = str(tmp_path / "bars")
    bars = B.ticks_to_bars(A.ticks(spark, FOLDER), "30m")
    store.write_bars(bars, path)
    some = bars.filter("trading_date = date'2024-01-05'").limit(3)
    store.write_bars(some, path)
    assert spark.read.parquet(path).count() == bars.filter("trading_date <> date'2024-01-05'").count() + 3


def test_state_upserts_and_seeding(spark):
    e, hits, moves = market.replayed(spark, FOLDER)
    state = store.seed_live(e, hits, moves)
    assert state["events"].filter("not is_active").count() == 0
    later = e.withColumns({"last_seen_at": F.timestamp_add("DAY", F.lit(1), F.col("last_seen_at")), "stage": F.lit("X")})
    out = store.write_events(state, {"events": later, "hits": hits, "lifecycle": moves})
    assert out["events"].count() == e.count() and out["events"].filter("stage <> 'X'").count() == 0
    assert out["hits"].count() == hits.count() and out["lifecycle"].count() == moves.count()
    stale = e.withColumn("stage", F.lit("OLD")).withColumn("last_seen_at", F.lit("1990-01-01 00:00:00").cast("timestamp_ntz"))
    again = store.write_events(out, {"events": stale, "hits": hits, "lifecycle": moves})
    assert again["events"].filter("stage = 'OLD'").count() == 0 and again["lifecycle"].count() == moves.count()


def test_merge_reconcile_and_archive(spark, tmp_path):
    key = ["k"]
    stored = spark.createDataFrame([(1, "a", 0, 300), (2, "b", 1, 400), (3, "c", 0, 200)], "k int, row_hash string, revision int, source_priority int")
    new = spark.createDataFrame([(1, "z", 300), (2, "y", 300), (3, "c", 300), (4, "n", 300)], "k int, row_hash string, source_priority int")
    merged = B.merge_bars(stored, new, key)
    assert [tuple(r) for r in B.reconciled(stored, merged, key).collect()] == [(1, "a", "z", 1)]
    days = spark.createDataFrame([(date(2024, 1, d), d) for d in range(1, 9)], "trading_date date, v int")
    manifest = M.archive(days, "trading_date", F.lit("2024-01-05").cast("date"), str(tmp_path / "old"))
    rows = {r.trading_date: r for r in manifest.collect()}
    assert len(rows) == 4 and all(r.rows == 1 and r.checksum for r in rows.values()) and rows[date(2024, 1, 2)].first == date(2024, 1, 2)


def test_retraction_by_newest_read(spark):
    slot = lambda s, at: ("A", "5m", date(2024, 1, 2), s, at)
    kind = "symbol string, frequency string, trading_date date, slot int, read_at int"
    bars, missing = R.apply_retractions(spark.createDataFrame([slot(1, 1), slot(2, 3), slot(3, 2)], kind), spark.createDataFrame([slot(1, 2), slot(2, 2), slot(3, 2), slot(4, 1)], kind))
    assert sorted(r.slot for r in bars.collect()) == [2, 3] and sorted(r.slot for r in missing.collect()) == [1, 4]


def test_replay_of_a_universe_and_range(spark):
    bars = market.intraday(spark, FOLDER)
    some = spark.createDataFrame([("U1",), ("U2",), ("NONE",)], "symbol string")
    first, last = (F.lit(x).cast("date") for x in ("2024-01-03", "2024-01-20"))
    events, results = P.replay_run(bars, some, first, last)
    summary = R.run_summary(results).first()
    assert (summary.completed_symbols, summary.failed_symbols, summary.run_status) == (2, 1, "partial") and summary.events == events.count() > 0
    assert {r.symbol for r in events.select("symbol").distinct().collect()} <= {"U1", "U2"}
    assert events.agg(F.min(F.to_date("discovered_at"))).first()[0] >= date(2024, 1, 3)


def test_ticks_from_the_wire(spark):
    row = A.from_wire(spark.createDataFrame([(12_345_600, 0, 12_350_000, 0)], "price_e6 long, bid_e6 long, ask_e6 long, pre_close_e6 long")).first()
    assert (row.price_ticks, row.bid_ticks, row.ask_ticks, row.pre_close_ticks) == (1235, None, 1235, None)


def test_latest_of_a_group_takes_each_column_from_the_newest_key_that_has_it(spark):
    at = datetime(2024, 1, 8, 10)
    rows = [("U1", at, "a", 7), ("U1", at, "b", None), ("U1", datetime(2024, 1, 7, 10), "z", 9), ("U2", at, "c", None), ("U3", at, "d", 1), ("U3", at, "e", 2)]
    events = spark.createDataFrame(rows, "symbol string, discovered_at timestamp_ntz, event_key string, wave_score int")
    found = events.groupBy("symbol").agg(F.max("discovered_at").alias("latest_pivot_at"))
    got = {(r.symbol, r.event_key, r.wave_score) for r in Q.with_latest(found, events, ["event_key", "wave_score"]).collect()}
    assert got == {("U1", "b", 7), ("U2", "c", None), ("U3", "e", 2)}


def test_replay_universe_of_symbols_with_several_suppliers(spark, tmp_path):
    """Three suppliers a symbol: names of its own by the eligible rows of the range only, other names by the least key of the newest day."""
    one = spark.read.parquet(f"{FOLDER}/supplier.parquet").limit(1)
    kept = {"s_name": F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")), "s_nationkey": F.lit(2), "s_suppkey": F.col("id")}
    keys = spark.range(3000, numPartitions=1).crossJoin(one).withColumns(kept).select(one.columns)
    keys.coalesce(1).sortWithinPartitions("s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(f"{FOLDER}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for t in ("supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = [tuple(r) for r in con.execute(catalogue.oracle_sql()["replay_universe"]).fetchall()]
    got = [(r.symbol, r["name"]) for r in catalogue.queries()["replay_universe"](spark, str(tmp_path)).collect()]
    assert got == want and sum(n.startswith("Own ") for _, n in got) not in (0, len(got))
