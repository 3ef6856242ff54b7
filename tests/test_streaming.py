from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebar.functions import session
from tidebar.operators import bars as B
from tidebar.operators import cards as C
from tidebar.operators import maintain as M
from tidebar.operators import pairs as P
from tidebar.sources.versions import VersionedTable, added, newest
from tidebar.sources.adapters import tick_rows
from tidebar.streaming import ticks as T


def events(spark, n=400):
    base = datetime(2024, 1, 2)
    rows = [(i, base + timedelta(minutes=(i * 37) % 1440), i % 9, "x", round(10 + (i * 7 % 300) / 100, 2), '{"k": %d}' % (i % 5 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def finish(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_ends_where_batch_does(spark, tmp_path):
    e = events(spark)
    folder = str(tmp_path / "events")
    e.repartition(3).write.parquet(folder)
    ticks = T.read_ticks(spark, folder)
    cols = ["symbol", "slot", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume", "tick_count"]
    got = sorted(map(tuple, finish(T.preview_bars(ticks, "5m"), "preview", "complete").select(*cols).collect()))
    assert got == sorted(map(tuple, B.ticks_to_bars(tick_rows(e), "5m").select(*cols).collect()))
    got = sorted(map(tuple, finish(T.latest_quotes(ticks), "latest", "complete").collect()))
    assert got == sorted(map(tuple, B.latest_quotes(tick_rows(e)).collect()))


def test_stream_of_events_ends_where_the_replay_does(spark, tmp_path):
    e = events(spark, 120)
    folder, out = str(tmp_path / "events"), str(tmp_path / "out")
    for i in range(2):
        e.filter(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(folder)
    T.stream_events(T.read_ticks(spark, folder), out, str(tmp_path / "check")).awaitTermination(180)
    five = B.ticks_to_bars(tick_rows(e), "5m")
    want = P.replay({"5m": five} | {f: B.roll_up(five, f) for f in ("30m", "60m", "1d")})
    cols = ["event_key", "stage", "generation", "break_eob", "total_hit_count"]
    held, alerts = T.event_tables(spark, out)
    assert sorted(map(str, held.read().select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    sent = alerts.read()
    # alerts of transitions that a later batch undid have been sent; none is sent twice
    own = {r.outbox_id for r in C.alerts(P.lifecycle(want), want).collect()}
    ids = [r.outbox_id for r in sent.collect()]
    assert own <= set(ids) and len(ids) == len(set(ids))
    # a batch that runs again changes nothing
    last = spark.read.parquet(f"{out}/ticks").filter("batch = 1").drop("batch", "bucket")
    T.replay_touched(spark, spark.createDataFrame(last.collect(), last.schema), 1, out)
    assert sorted(map(str, held.read().select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert alerts.read().count() == len(ids)


def test_dedupe_by_session_sequence(spark, tmp_path):
    e = events(spark, 60)
    folder = str(tmp_path / "events")
    e.unionByName(e.filter("event_id % 2 = 0")).coalesce(1).write.parquet(folder)
    ticks = T.read_ticks(spark, folder)
    assert finish(T.dedupe(ticks), "once", "append").count() == 60
    named = ticks.withColumns({"session_id": F.lit("s"), "worker_sequence": F.col("event_id") % 20})
    assert finish(T.dedupe(named), "sequence", "append").count() == tick_rows(e).selectExpr("worker_id", "event_id % 20").distinct().count()


def test_preview_bars_name_their_sources(spark):
    t = tick_rows(events(spark, 50)).withColumn("collection_mode", F.when(F.col("event_id") % 2 == 0, "SUBSCRIBE").otherwise("SNAPSHOT_POLL"))
    rows = T.preview_bars(t, "1d").collect()
    assert {r.source_mode for r in rows} <= {"MIXED", "SUBSCRIBE", "SNAPSHOT_POLL"} and all((r.quality == "PARTIAL") == (r.source_mode == "MIXED") for r in rows)
    fresh = t.withColumn("source_priority", F.when(F.col("collection_mode") == "SUBSCRIBE", 300).otherwise(200)).withColumn("event_time", F.lit(datetime(2024, 1, 2, 10)).cast("timestamp_ntz"))
    assert all(r.event_id % 2 == 0 for r in T.latest_quotes(fresh).collect())


def test_bar_lifecycle(spark):
    bar = lambda slot, h, f="5m": ("A", f, datetime(2024, 1, 2).date(), slot, datetime(2024, 1, 2, 9, 30) + timedelta(minutes=5 * (slot + 1)), h)
    kind = "symbol string, frequency string, trading_date date, slot int, eob timestamp_ntz, row_hash string"
    held = spark.createDataFrame([], kind + ", closed boolean, revision int")
    seen = []
    for now, bars in [("09:34:00", [bar(0, "a")]), ("09:34:30", [bar(0, "a")]), ("09:35:02", [bar(0, "b"), bar(1, "x")]), ("09:35:03", []), ("09:36:00", [bar(0, "c")]), ("09:37:30", [bar(0, "d")]), ("10:00:00", [])]:
        held, out = T.bar_lifecycle(held, spark.createDataFrame(bars, kind), F.lit(f"2024-01-02 {now}").cast("timestamp_ntz"))
        rows = out.collect()
        held = spark.createDataFrame(held.collect(), held.schema)
        seen.append(sorted((r.slot, r.event_type, r.row_hash, r.revision) for r in rows))
    assert seen == [[(0, "BarUpdated", "a", 0)], [], [(0, "BarUpdated", "b", 0), (1, "BarUpdated", "x", 0)], [(0, "BarClosed", "b", 0)], [(0, "BarRevised", "c", 1)], [], [(1, "BarClosed", "x", 0)]]
    assert {r.slot: (r.row_hash, r.closed, r.revision) for r in held.collect()} == {0: ("c", True, 1), 1: ("x", True, 0)}


def level_rows(ticks, when):
    best = ticks.groupBy("symbol").agg(F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), (F.col(c) - sign * d).alias("ticks")) for s, c, sign in (("TOP", "high", 1), ("BOTTOM", "low", -1)) for d in (-3, 0, 3, 60, 150)]))
    return best.select("symbol", sides.alias("x")).select("symbol", "x.*").withColumns({"event_key": F.concat_ws("|", "symbol", "side", "ticks"), "first_seen_at": F.lit(when).cast("timestamp_ntz")})


def plain_breaks(ticks, levels):
    out = {}
    for l in levels:
        beyond = [t for t in ticks if t.symbol == l.symbol and t.event_time > l.first_seen_at and (t.price_ticks > l.ticks if l.side == "TOP" else t.price_ticks < l.ticks)]
        if beyond:
            first = min(beyond, key=lambda t: (t.event_time, t.event_id))
            out[l.event_key] = (first.event_time, first.price_ticks)
    return out


def test_first_breaks_are_those_of_every_tick_in_turn(spark):
    e = events(spark, 300).withColumn("ts", F.timestamp_add("DAY", (F.col("event_id") % 3).cast("int"), F.col("ts")))
    ticks = tick_rows(e)
    for when in ("2024-01-01 10:00:00", "2024-01-02 10:31:00", "2024-01-03 13:10:00", "2024-01-09 09:30:00"):
        levels = level_rows(ticks, when)
        got = {r.event_key: (r.event_time, r.price_ticks) for r in T.first_breaks(ticks, levels).collect()}
        assert got == plain_breaks(ticks.collect(), levels.collect()), when


def test_levels_break_once(spark, tmp_path):
    ticks = tick_rows(events(spark, 200))
    levels = level_rows(ticks, "2024-01-02 09:30:00")
    table = VersionedTable(spark, str(tmp_path / "levels"), ["symbol"], 8)
    table.change(levels, added(["event_key"]))
    moves = [T.break_levels(ticks.filter(F.col("event_id") % 2 == part), table, part) for part in (0, 1)]
    rows = [r for m in moves for r in m.collect()]
    assert len(rows) == len({r.event_key for r in rows}) == T.first_breaks(ticks, levels).count() > 0
    assert table.read().count() == levels.count() - len(rows)
    assert {r.reason for r in rows} == {"TICK_HIGHER_PRICE_BREAK", "TICK_LOWER_PRICE_BREAK"} and {r.to_stage for r in rows} == {"INVALIDATED"}
    assert T.break_levels(ticks.filter(F.col("event_id") % 2 == 1), table, 1) is None


def test_incremental_windows_overlap_by_one_bar_and_commit_with_their_work(spark, tmp_path):
    bars = B.ticks_to_bars(tick_rows(events(spark, 300)), "30m").select("symbol", "frequency", "eob", "close_ticks")
    out, seen = VersionedTable(spark, str(tmp_path / "out"), ["symbol"], 4), []
    merge = newest(["symbol", "frequency", "eob"], ["close_ticks"])
    first = bars.filter("eob <= timestamp_ntz'2024-01-02 10:30:00'")

    def work(rows):
        seen.append(rows.count())
        return rows

    T.run_incremental(first, out, work, merge)
    held = out.version()

    def fail(*_):
        raise RuntimeError("no")

    # dies in its work, dies between the rows and the version: the last version stays, marks included
    for broken in (lambda: T.run_incremental(bars, out, fail, merge), lambda: T.run_incremental(bars, out, lambda rows: rows, fail)):
        with pytest.raises(RuntimeError):
            broken()
    out._commit, commit = fail, out._commit
    with pytest.raises(RuntimeError):
        T.run_incremental(bars, out, lambda rows: rows, merge)
    out._commit = commit
    assert out.version() == held and out.read().count() == first.count()
    marks = T.run_incremental(bars, out, work, merge)
    overlap = bars.filter("eob = timestamp_ntz'2024-01-02 10:30:00'").count()
    assert seen == [first.count(), bars.count() - first.count() + overlap] and overlap
    assert marks == {"30m": str(bars.agg(F.max("eob")).first()[0])} and out.read().count() == bars.count()


def test_cards_ranks_and_changes(spark):
    rows = spark.createDataFrame([(1, "info"), (2, "error"), (3, "warning"), (4, "other")], "change_id int, severity string")
    assert [r.severity for r in M.by_rank(rows, "severity", ["error", "warning"], F.asc("change_id")).collect()] == ["error", "warning", "info", "other"]
    assert [r.change_id for r in M.changes_after(rows, 1, 2).collect()] == [2, 3, 4]
    assert [r.s for r in rows.select(session.normal_frequency(F.lit(" 1800S ")).alias("s")).limit(1).collect()] == ["30m"]
    at = lambda t, trading=True: rows.limit(1).select(session.status(F.lit(f"2024-01-02 {t}").cast("timestamp_ntz"), F.lit(trading)).alias("s")).first().s
    assert [at("09:00:00"), at("10:00:00"), at("12:00:00"), at("14:00:00"), at("15:00:00"), at("10:00:00", False)] == ["PRE_OPEN", "MORNING", "LUNCH", "AFTERNOON", "CLOSED", "CLOSED"]


def test_late_rows_are_split(spark):
    t = tick_rows(events(spark))
    now = F.lit("2024-01-02 10:00:00").cast("timestamp_ntz")
    ok, late = T.split_late(t, now, 3600)
    assert ok.count() + late.count() == t.count() and 0 < ok.count() < t.count()
    assert ok.agg(F.max("event_time")).first()[0] <= datetime(2024, 1, 2, 10, 0, 30)


def test_upsert_counts_revisions(spark):
    cur = spark.createDataFrame([("a", 1, "x", 0), ("b", 5, "y", 2)], "k string, t int, v string, revision int")
    new = spark.createDataFrame([("a", 2, "z"), ("a", 3, "w"), ("b", 4, "old"), ("c", 1, "n")], "k string, t int, v string")
    got = {r.k: (r.t, r.v, r.revision) for r in T.upsert_latest(new, cur, ["k"], ["t"]).collect()}
    assert got == {"a": (3, "w", 1), "b": (5, "y", 2), "c": (1, "n", 0)}
