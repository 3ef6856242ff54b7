"""Tables that jobs keep: derived tables beside their inputs, partitions that are overwritten, upserts, seeding."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a session in one process without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def staged(rows: DataFrame, tag: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back: what uses it more than once computes it once."""
    path = f"{shared_folder(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Of the files under paths: their names, sizes and times."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    found = files.agg(F.count("*"), F.sum("length"), F.max("at"), F.sum(F.xxhash64("path", "length", "at").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((paths, tuple(found))).encode()).hexdigest()[:24]


#: Counted up when the rules of stored derived tables change, so that none of the old ones is read.
RULES = 3


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[], DataFrame], settings: tuple = ()) -> DataFrame:
    """The derived table `name` of these inputs and settings: read if it was stored for the same files, settings and rules, else built and
    stored. A pointer is written after the table is whole, so a job that died leaves nothing that would be read."""
    pointer = f"{shared_folder(spark)}/{name}-r{RULES}-{hashlib.sha256(repr(settings).encode()).hexdigest()[:8]}-{fingerprint(spark, paths)}"
    try:
        return spark.read.parquet(spark.read.schema("path string").parquet(pointer).first()["path"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    path = f"{pointer}-{uuid.uuid4().hex}"
    build().write.parquet(path)
    spark.createDataFrame([(path,)], "path string").write.mode("overwrite").parquet(pointer)
    return spark.read.parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars by frequency and day; only the days that the rows have are replaced."""
    bars.repartition("frequency", "trading_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("frequency", "trading_date").parquet(path)


def upsert(current: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Both tables' rows, of each key the one latest in order; what is held loses ties to what is new."""
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(c) for c in [*order, "_new"]])
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def insert_new(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """current and the batch's rows of keys that it does not have, each once."""
    return current.unionByName(batch.dropDuplicates(key).join(current.select(*key), key, "left_anti"))


def write_events(state: dict[str, DataFrame], batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """events and hits upserted by their keys, lifecycle rows only added."""
    return {
        "events": upsert(state["events"], batch["events"], ["event_key"], ["last_seen_at"]),
        "hits": upsert(state["hits"], batch["hits"], ["hit_key"], ["eob"]),
        "lifecycle": insert_new(state["lifecycle"], batch["lifecycle"], ["event_key", "to_stage", "at"]),
    }


def seed_live(events: DataFrame, hits: DataFrame, lifecycle: DataFrame) -> dict[str, DataFrame]:
    """The live state after a finished replay: its active events with their hits and lifecycle."""
    live = events.filter("is_active")
    own = live.select("event_key")
    return {"events": live, "hits": hits.join(own, "event_key", "left_semi"), "lifecycle": lifecycle.join(own, "event_key", "left_semi")}


def replace(rows: DataFrame, path: str) -> None:
    """Writes a state table anew under a path of its own; readers follow the pointer that is written last."""
    target = f"{path}-{uuid.uuid4().hex}"
    rows.write.parquet(target)
    rows.sparkSession.createDataFrame([(target,)], "path string").coalesce(1).write.mode("overwrite").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state table that `replace` wrote last; None before the first."""
    try:
        return spark.read.parquet(spark.read.schema("path string").parquet(path).first()["path"])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
