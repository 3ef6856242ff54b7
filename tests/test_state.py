"""Streams with keyed state: fixtures by the letter, and equality with the batch form."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tidebar import catalogue
from tidebar.operators import bars as B
from tidebar.operators import pairs as P
from tidebar.sources.adapters import tick_rows
from tidebar.streaming import state as S

DAY = datetime(2024, 1, 2)


def now():
    return F.lit("2024-01-02 10:00:00").cast("timestamp_ntz")


def finish(stream, tmp_path, name, mode):
    seen = []
    own = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"check-{name}"))
    q = own.foreachBatch(lambda batch, number: seen.extend((number, *r) for r in batch.collect())).trigger(availableNow=True).start()
    q.awaitTermination(150)
    assert q.exception() is None
    return seen


def feed(spark, tmp_path, name, batches, schema):
    """Rows of each batch as one file, read one after the other."""
    folder = str(tmp_path / name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


TICK = "worker_id string, session_id string, worker_sequence long, event_id long, arrival long, event_time timestamp_ntz"


def test_gate_keeps_a_high_water_mark(spark, tmp_path):
    fresh, old = DAY.replace(hour=9, minute=59, second=30), DAY.replace(hour=9, minute=40)
    rows = [("w", "s", 5, 1, 1, fresh), ("w", "s", 3, 2, 2, fresh), ("w", "s", 9, 3, 3, old), ("w", "s", 8, 4, 4, fresh)]
    want = {1: "ACCEPTED", 2: "DUPLICATE", 3: "EXPIRED", 4: "DUPLICATE"}
    assert {r.event_id: r.verdict for r in S.gate(spark.createDataFrame(rows, TICK), now()).collect()} == want
    later = [("w", "s", 9, 5, 5, fresh), ("w", "s", 10, 6, 6, fresh), ("w", "t", 1, 7, 7, fresh), ("v", "s", 2, 8, 8, fresh)]
    stream = S.stream_gate(feed(spark, tmp_path, "ticks", [rows, later], TICK), now())
    got = {r[4]: r[5] for r in finish(stream, tmp_path, "gate", "append")}
    assert got == want | {5: "DUPLICATE", 6: "ACCEPTED", 7: "ACCEPTED", 8: "ACCEPTED"}
    assert got == {r.event_id: r.verdict for r in S.gate(spark.createDataFrame(rows + later, TICK), now()).collect()}


def test_a_silent_symbols_bar_is_closed_and_revised_in_its_window(spark, tmp_path):
    schema = "symbol string, trading_date date, minute int, event_time timestamp_ntz, event_id long, price_ticks long, volume long, received_at timestamp_ntz"
    at = lambda h, m, s=0: DAY.replace(hour=h, minute=m, second=s)
    tick = lambda symbol, t, i, price, received=None: (symbol, DAY.date(), (t.hour * 60 + t.minute) - 570, t, i, price, 10, received or t)
    batches = [
        [tick("A", at(9, 31), 1, 1000), tick("A", at(9, 33), 2, 1010)],
        [tick("B", at(9, 36), 3, 500)],  # only B ticks on: A's bar is over
        [tick("A", at(9, 32), 4, 990, at(9, 36, 30))],  # late, within the window
        [tick("B", at(9, 50), 5, 505)],
        [tick("A", at(9, 34), 6, 900, at(9, 50, 5)), tick("B", at(9, 50, 6), 7, 505)],  # beyond it
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    got = [(r[-1], r[4], r[6:11], r[13]) for r in finish(S.stream_bars(stream, ("5m",)), tmp_path, "bars", "update") if r[1] == "A"]
    assert got == [("BarUpdated", 0, (1000, 1010, 1000, 1010, 20), 0), ("BarClosed", 0, (1000, 1010, 1000, 1010, 20), 0), ("BarRevised", 0, (1000, 1010, 990, 1010, 30), 1)]


def ticks(spark, n):
    rows = [(i, DAY + timedelta(minutes=(i * 37) % 1440, days=i % 3), i % 4, "x", round(10 + (i * 7 % 130) / 100, 2), '{"k": %d}' % (i % 5 + 1)) for i in range(n)]
    return tick_rows(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))


MOVE = ["event_key", "to_stage", "at", "reason", "notify"]


def closed_bars(spark, n=900):
    five = B.ticks_to_bars(ticks(spark, n), "5m")
    bars = {"5m": five} | {f: B.roll_up(five, f) for f in ("30m", "60m", "1d")}
    rows = None
    for b in bars.values():
        own = b.select("symbol", "frequency", "eob", "high_ticks", "low_ticks")
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("event_id", F.sha2(F.concat_ws("|", "symbol", "frequency", F.col("eob").cast("string")), 256))
    return bars, rows.toPandas()


def test_pair_events_of_a_stream_are_those_of_the_replay(spark, tmp_path):
    bars, rows = closed_bars(spark)
    want = P.lifecycle(P.replay(bars)).select(*MOVE)
    schema = "symbol string, frequency string, eob timestamp_ntz, high_ticks long, low_ticks long, event_id string"
    cuts = sorted(rows["eob"].unique())
    bounds = [cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3]]
    parts = [rows[rows.eob <= bounds[0]], rows[(rows.eob > bounds[0]) & (rows.eob <= bounds[1])], rows[rows.eob > bounds[1]]]
    # ids come again, in the next batch and in their own
    parts = [parts[0], pd.concat([parts[1], parts[0].tail(15), parts[1].head(9)]), pd.concat([parts[2], parts[1].tail(20)])]
    stream = feed(spark, tmp_path, "bars", [p.sample(frac=1, random_state=1) for p in parts], schema)
    seen = finish(S.stream_pair_events(stream), tmp_path, "events", "append")
    got = sorted(str((r[1], r[7], r[8], r[9], r[10])) for r in seen)
    assert got == sorted(str(tuple(r)) for r in want.collect()) and len(got) > 100
    # a bar of another id that comes too late asks for its symbol to be computed anew, and changes nothing
    levels = S.Levels("A", {}, {})
    list(levels.apply("5m", "2024-01-02 10:00:00", 1100, 1001))
    late = list(levels.apply("5m", "2024-01-02 09:55:00", 1200, 900))
    assert [(m[6], m[7], m[8]) for m in late] == [("RECOMPUTE", "2024-01-02 09:55:00", "LATE_5m")] and levels.active == {"TOP": [1100], "BOTTOM": []}


def test_strict_breaks_only():
    """Equality never breaks; a bar breaks what lies below its high and above its low, and hits its own prices afterwards."""
    levels = S.Levels("A", {}, {})
    step = lambda t, high, low: [(m[6], m[2], m[3]) for m in levels.apply("5m", f"2024-01-02 {t}:00", high, low)]
    assert step("09:35", 1200, 1100) == [("DISCOVERED", "TOP", 1200), ("DISCOVERED", "BOTTOM", 1100)]
    assert step("09:40", 1200, 1100) == [] and levels.events["TOP", 1200][6] == 2
    assert step("09:45", 1201, 1100) == [("INVALIDATED", "TOP", 1200)]
    assert step("09:50", 1200, 1099) == [("INVALIDATED", "BOTTOM", 1100), ("DISCOVERED", "TOP", 1200), ("DISCOVERED", "BOTTOM", 1099)]
    assert levels.events["TOP", 1200][3] == 2


def test_fresh_to_the_microsecond(spark):
    at = lambda **x: now_at + timedelta(**x)
    now_at = DAY.replace(hour=12)
    rows = [("w", str(i), 1, i, i, t) for i, t in enumerate([at(seconds=-120), at(seconds=-120, microseconds=-1), at(seconds=30), at(seconds=30, microseconds=1)])]
    ticks = spark.createDataFrame(rows, TICK)
    got = {r.event_id: r.verdict for r in S.gate(ticks, F.lit(now_at.isoformat(" ")).cast("timestamp_ntz")).collect()}
    assert got == {0: "ACCEPTED", 1: "EXPIRED", 2: "ACCEPTED", 3: "EXPIRED"}


def test_tick_gate_at_the_ends_of_its_window(spark, tmp_path):
    """The query counts in whole seconds, as its SQL does."""
    noon = DAY.replace(hour=12)
    offsets = [timedelta(seconds=s, microseconds=u) for s in (-21601, -21600, -21599, 29, 30, 31) for u in (0, 1, 999_999)]
    rows = [(i, noon + o + timedelta(days=i), i, "x", 1.0, "{}") for i, o in enumerate(offsets)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r[2] for r in con.execute(catalogue.oracle_sql()["tick_gate"]).fetchall()}
    got = {r.event_id: r.verdict for r in catalogue.queries()["tick_gate"](spark, str(tmp_path)).collect()}
    assert got == want and set(got.values()) == {"ACCEPTED", "EXPIRED"}
