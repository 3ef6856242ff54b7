"""State tables under a log of versions."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.sources.versions import BAR_KEY, VersionedTable, added, newest, without, write_official_bars

ROWS = "k long, at int, v string"


def rows(table):
    found = table.read()
    return {} if found is None else {r.k: (r.at, r.v) for r in found.collect()}


def size(path):
    return sum(os.path.getsize(x) for x in glob.glob(f"{path}/rows/**/*.parquet", recursive=True))


def test_a_change_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    table = VersionedTable(spark, path, ["k"], 16)
    assert table.read() is None and rows(table) == {}
    first = spark.createDataFrame([(i, 1, "x" * 50) for i in range(4000)], ROWS)
    table.change(first, newest(["k"], ["at"]), 0, {"a": "1"})
    before, whole = table.version(), size(path)
    assert len(before.places) == 16 and before.marks == {"a": "1"}
    batch = spark.createDataFrame([(5, 2, "new"), (5, 3, "newer"), (6, 0, "old")], ROWS)
    after = table.change(batch, newest(["k"], ["at"]), 1, {"b": "2"})
    moved = [b for b in after.places if after.places[b] != before.places[b]]
    assert len(moved) <= 2 and size(path) - whole < whole / 4
    assert rows(table)[5] == (3, "newer") and rows(table)[6] == (1, "x" * 50) and len(rows(table)) == 4000
    assert after.marks == {"a": "1", "b": "2"}
    # the same batch again, and an older one, change nothing
    assert table.change(batch.withColumn("at", F.lit(9)), newest(["k"], ["at"]), 1) == after == table.version()
    # a reader of the last version goes on while the next comes; older ones go
    held = table.read(before)
    assert held.filter("k = 5").first().v == "x" * 50
    table.change(spark.createDataFrame([(7, 5, "z")], ROWS), newest(["k"], ["at"]), 2)
    assert table._numbers() == [1, 2] and size(path) < 2 * whole


def test_a_batch_that_dies_leaves_the_last_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.change(spark.createDataFrame([(i, 1, "x") for i in range(20)], ROWS), newest(["k"], ["at"]), 0)
    want, held = rows(table), table.version()
    boom = F.udf(lambda k: 1 // (k - 3) and "y", "string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        table.change(spark.createDataFrame([(i, 2, "y") for i in range(6)], ROWS).withColumn("v", boom("k")), newest(["k"], ["at"]), 1)
    assert rows(table) == want and table.version() == held
    table.change(spark.createDataFrame([(3, 2, "y")], ROWS), newest(["k"], ["at"]), 1)
    assert rows(table) == want | {3: (2, "y")}


def test_keys_come_in_once_and_go(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.change(spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "b")], ROWS), added(["k"]))
    table.change(spark.createDataFrame([(1, 2, "other"), (3, 1, "c")], ROWS), added(["k"]))
    assert rows(table) == {1: (1, "a"), 2: (1, "b"), 3: (1, "c")}
    gone = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    table.change(table.read().limit(0), without(gone, ["k"]), touched=gone)
    assert table.read() is None and table.version().number == 2


def test_official_bars_are_revised_as_their_sources_rank(spark, tmp_path):
    schema = "symbol string, frequency string, trading_date date, slot int, open_ticks long, high_ticks long, low_ticks long, close_ticks long, volume long, amount_ticks long, source_priority int"
    day = __import__("datetime").date(2024, 1, 2)
    bar = lambda slot, close, priority: ("A", "5m", day, slot, 10, 30, 5, close, 1, 10, priority)
    table = VersionedTable(spark, str(tmp_path / "bars"), ["symbol", "trading_date"], 4)
    batches = [[bar(0, 10, 200), bar(1, 11, 400)], [bar(0, 12, 300), bar(1, 13, 300), bar(2, 14, 300)], [bar(0, 12, 300)]]
    for i, b in enumerate(batches):
        write_official_bars(table, B.with_row_hash(spark.createDataFrame(b, schema)), i)
    assert {r.slot: (r.close_ticks, r.revision, r.source_priority) for r in table.read().collect()} == {0: (12, 1, 300), 1: (11, 0, 400), 2: (14, 0, 300)}
    assert set(BAR_KEY) <= set(table.read().columns)
