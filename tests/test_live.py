"""Live state: upserts by bucket, the projection kept up to date against one built anew, bars that scans need not exchange."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import daily as D
from tidebar.operators import maintain as M
from tidebar.operators import pairs as P
from tidebar.operators import surface as Q
from tidebar.sources import store
from tidebar.sources.adapters import tick_rows
from tidebar.sources.live import LiveProjection, LiveState, store_bars


def replayed(spark, n=700):
    base = datetime(2024, 1, 2)
    rows = [(i, base + timedelta(minutes=(i * 37) % 1440, days=i % 4), i % 6, "x", round(10 + (i * 7 % 130) / 100, 2), '{"k": %d}' % (i % 5 + 1)) for i in range(n)]
    ticks = tick_rows(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    five = store.staged(B.ticks_to_bars(ticks, "5m"), "bars")
    frames = {"5m": five} | {f: B.roll_up(five, f) for f in ("30m", "60m", "1d")}
    e = store.staged(P.replay(frames), "events")
    return frames, e, store.staged(P.evidence(e, P.with_breaks(P.pair_hits(five), five)), "hits"), P.lifecycle(e)


def rows(df, columns=None):
    return sorted(map(str, df.select(*(columns or sorted(df.columns))).collect()))


def test_live_state_and_projection(spark, tmp_path):
    _, e, hits, moves = replayed(spark)
    live = LiveState(spark, str(tmp_path / "live"), 4)
    live.write({"events": e, "hits": hits, "lifecycle": moves}, 0)
    assert rows(live.read("events")) == rows(e) and rows(live.read("hits")) == rows(hits) and rows(live.read("lifecycle")) == rows(moves)
    later = e.filter("symbol = 'U1'").withColumns({"last_seen_at": F.timestamp_add("DAY", F.lit(1), F.col("last_seen_at")), "stage": F.lit("X")})
    for _ in range(2):  # the second time it has been written
        live.write({"events": later, "hits": hits.limit(0), "lifecycle": moves.filter("symbol = 'U1'")}, 1)
    assert rows(live.read("events")) == rows(e.filter("symbol <> 'U1'").unionByName(later)) and live.read("lifecycle").count() == moves.count()

    cutoff = F.lit("2024-01-04 10:00:00").cast("timestamp_ntz")
    view = LiveProjection(spark, str(tmp_path / "view"), cutoff, 4)
    named = lambda d: d.withColumns({"symbol_name": F.concat(F.lit("n"), "symbol"), "wave_status": F.lit("COMPLETED"), "wave_score": (F.col("ticks") % 97).cast("int"), "wave_signal": F.lit("NONE")})
    none = e.select("symbol", "event_key").limit(0)
    view.apply(named(e), none, 0)
    # the largest scores of a symbol go, others change, a symbol goes as a whole
    gone = e.filter("symbol = 'U4' OR (symbol = 'U2' AND ticks % 97 > 40)").select("symbol", "event_key")
    changed = named(e.filter("symbol = 'U3'")).withColumn("wave_score", F.lit(3))
    before = view.rows.version()
    for _ in range(2):
        view.apply(changed, gone, 1)
    now = named(e).join(gone, ["symbol", "event_key"], "left_anti").filter("symbol <> 'U3'").select(*named(e).columns).unionByName(changed.select(*named(e).columns))
    want = Q.build_projection(now)
    assert rows(view.rows.read(), want.columns) == rows(want, want.columns)
    assert M.difference(view.rows.read().select(*want.columns), want, ["event_key"]).count() == 0
    counted = Q.groups(want, cutoff)
    assert rows(view.groups.read(), counted.columns) == rows(counted, counted.columns) and counted.count() == 5
    # buckets of other symbols are where they were
    kept = {b for b in before.places if view.rows.version().places.get(b) == before.places[b]}
    own = {r.b for r in e.select(view.rows.bucket().alias("b"), "symbol").filter("symbol in ('U2', 'U3', 'U4')").select("b").distinct().collect()}
    assert kept == set(before.places) - own


def test_stored_bars_are_scanned_without_exchange(spark):
    frames, *_ = replayed(spark, 300)
    columns = ["symbol", "frequency", "trading_date", "eob", "open_ticks", "high_ticks", "low_ticks", "close_ticks", "volume"]
    every = frames["5m"].select(*columns).unionByName(frames["1d"].select(*columns))
    store_bars(every, "stored_bars", 4)
    try:
        daily = spark.table("stored_bars").filter("frequency = '1d'")
        out = D.moving_averages(daily)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(frequency" in plan
        want = D.moving_averages(frames["1d"].select(*columns))
        assert rows(out, sorted(want.columns)) == rows(want)
    finally:
        spark.sql("DROP TABLE stored_bars")
