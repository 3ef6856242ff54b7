"""Affected days computed anew against a full replay."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidebar import catalogue
from tidebar.operators import bars as B
from tidebar.operators import pairs as P
from tidebar.operators import recovery as R
from tidebar.operators import universe as U
from tidebar.plans.operations import universe
from tidebar.sources import store
from tidebar.sources.adapters import tick_rows

COLUMNS = ["event_key", "symbol", "generation", "stage", "score", "discovered_at", "observed_at", "focused_at", "established_at", "break_eob", "break_ticks", "hits_5m", "last_seen_at", "last_hit_at"]


def frames(five):
    return {"5m": five} | {f: B.roll_up(five, f) for f in ("30m", "60m", "1d")}


def test_affected_days_give_what_a_full_replay_gives(spark):
    base = datetime(2024, 1, 2)
    rows = [(i, base + timedelta(minutes=(i * 37) % 1440, days=i % 5), i % 6, "x", round(10 + (i * 7 % 130) / 100, 2), '{"k": %d}' % (i % 5 + 1)) for i in range(1500)]
    ticks = tick_rows(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    late = "event_id % 11 = 3 AND trading_date >= DATE '2024-01-04' AND symbol IN ('U0', 'U3', 'U4')"
    early, five = (store.staged(B.ticks_to_bars(t, "5m"), "bars") for t in (ticks.filter(f"NOT ({late})"), ticks))
    held = store.staged(P.replay(frames(early)), "held")
    hits = store.staged(P.evidence(held, P.with_breaks(P.pair_hits(early), early)), "hits")
    changed = R.changed_slots(B.with_row_hash(early), B.with_row_hash(five))
    days = store.staged(R.affected_days(changed, five, {"5m": 1}, {"5m": 48}), "days")
    found = {r.symbol: str(r.from_day) for r in days.collect()}
    assert set(found) == {"U0", "U3", "U4"} and min(found.values()) >= "2024-01-03"
    # bars before the affected days, and those of other symbols, need not be there
    bars = {f: b.join(days, "symbol").filter("trading_date >= from_day").drop("from_day") for f, b in frames(five).items()}
    events, gone = R.recompute(held, hits, bars, days)
    want = P.replay(frames(five))
    got = sorted(map(str, events.select(*COLUMNS).collect()))
    assert got == sorted(map(str, want.select(*COLUMNS).collect())) and len(got) > 50
    old, new = ({r.event_key for r in d.select("event_key").collect()} for d in (held, want))
    assert {r.event_key for r in gone.collect()} == old - new and old != new
    # nothing changed, nothing to do
    same, none = R.recompute(held, hits, bars, days.limit(0))
    assert same.count() == held.count() and none.count() == 0


def test_eligible_symbols_of_a_day_before_all_statuses(spark):
    rows = [("A", "2024-01-03", True), ("B", "2024-01-05", True), ("C", "2024-01-05", False)]
    u = spark.createDataFrame(rows, "symbol string, trading_date string, is_eligible boolean").withColumn("trading_date", F.to_date("trading_date"))
    at = lambda day: [r.symbol for r in U.eligible_at(u, F.lit(day).cast("date")).collect()]
    assert at("2024-01-04") == ["A"] and at("2024-01-09") == ["B"] and at("2020-01-01") == ["B"]


def test_status_quality_by_adapter(spark):
    raw = [("SHSE.600000", "a", '{"_universe_adapter": "get_symbols"}', None), ("SHSE.600001", "b", '{"_universe_adapter": "get_instruments-current-snapshot"}', "HALTED"), ("SHSE.900001", "*ST c", "{}", "x"), ("SZSE.300001", "ST d", None, None)]
    rows = U.classify(spark.createDataFrame([(*r[:3], False, r[3]) for r in raw], "symbol string, name string, raw_attributes string, is_suspended boolean, exclusion_reason string")).collect()
    assert [(r.status_quality, r.status_source, r.exclusion_reason) for r in rows] == [
        ("historical_exact", "get_symbols", None), ("estimated_current_snapshot", "get_instruments-current-snapshot", "HALTED"), ("unknown", "legacy_unknown", "NOT_A_SHARE"), ("unknown", "legacy_unknown", "ST"),
    ]


def test_symbols_without_bars_fail(spark):
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "symbol string")
    got = {r.symbol: (r.bars, r.hits, r.events, r.status) for r in R.symbol_results(one("A", "B"), one("A", "A"), one("A"), one("A").limit(0)).collect()}
    assert got == {"A": (2, 1, 0, "complete"), "B": (0, 0, 0, "failed")}


def test_search_puts_the_equal_symbol_first(spark):
    rows = [("S10", "x", True), ("S1", "y", True), ("A", "S1 z", False), ("S11", "w", True), ("B", "none", True)]
    found = U.search(spark.createDataFrame(rows, "symbol string, name string, is_eligible boolean"), "S1", 3)
    assert [r.symbol for r in found.collect()] == ["S1", "S10", "S11"]


def test_instrument_search_finds_by_any_part(spark):
    """Its SQL looks for '1' in names and symbols, with S1 first."""
    found = [r.symbol for r in catalogue.queries()["instrument_search"](spark, "/root/testdata/sf0.01").collect()]
    rows = [("S" + str(r.s_suppkey), r.s_name, r.s_acctbal >= 0) for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()]
    want = sorted((not ok, s != "S1", s) for s, name, ok in rows if "1" in s or "1" in name)[:50]
    assert found == [s for _, _, s in want] and any(not s.startswith("S1") for s in found)
    rows = [("S10", "x", True), ("S1", "y", True), ("A", "n1", True)]
    got = U.search(spark.createDataFrame(rows, "symbol string, name string, is_eligible boolean"), "1", exact="S1")
    assert [r.symbol for r in got.collect()] == ["S1", "A", "S10"]


def test_snapshots_differ_in_as_many_tasks_as_there_are_rows_for(spark, tmp_path, monkeypatch):
    rows = lambda *names: spark.createDataFrame([(n[0], n) if n else ("x", None) for n in names], "symbol string, name string")
    a, b = rows("a1", "a1", "b1", "c1", None, None), rows("a1", "b1", "b2", "c1", None, "b2")
    monkeypatch.setattr(U, "ROWS_A_TASK", 2)
    found = U.differences(a, b, ["symbol"])
    assert {(r["name"], r.side, r.copies) for r in found.collect()} == {("a1", "first", 1), ("b2", "second", 2), (None, "first", 1)}
    # a universe of many instruments is made, and two of its snapshots are compared, in several tasks
    one = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(1)
    spark.range(25_000).crossJoin(one).withColumn("s_suppkey", F.col("id")).select(one.columns).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "events.parquet"))
    assert universe(spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_recomputed_events_read_ticks_only_to_make_bars(spark, monkeypatch):
    """What replays and recomputes reads stored bars, as it does so dozens of times."""
    seen, replay, recompute = [], P.replay, R.recompute
    monkeypatch.setattr(P, "replay", lambda bars: seen.append(bars) or replay(bars))
    monkeypatch.setattr(R, "recompute", lambda events, hits, bars, days: seen.append(bars) or recompute(events, hits, bars, days))
    catalogue.queries()["recomputed_events"](spark, "/root/testdata/sf0.001")
    catalogue.queries()["pair_events"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("events.parquet" in f for bars in seen for b in bars.values() for f in b.inputFiles())
