"""State tables that are changed in place of being rewritten: hash buckets, copied on write, under a log of versions.

A change rewrites only the buckets that hold its keys; their new files lie beside the old ones until one small file, the version, names
for every bucket where its rows are. It also carries the batch that made it and that batch's marks, so table and marks change together: a
job that dies before leaves the last version as it was, and a batch that runs again finds itself in the log and changes nothing.
Versions and files that no kept version names are removed. One writer at a time; readers follow the newest version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay, for readers that have begun.
KEEP = 2
_LOG = "version long, batch_id long, marks string, bucket int, location string"


@dataclass
class Version:
    number: int = -1
    batch_id: int = -1
    marks: dict = field(default_factory=dict)
    #: bucket -> folder of its rows
    places: dict[int, str] = field(default_factory=dict)


class VersionedTable:
    """Rows by key in `buckets` hash buckets under path (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _files(self):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        """Versions that are committed: a version's folder has its mark of success."""
        fs, of = self._files()
        log = of(f"{self.path}/log")
        if not fs.exists(log):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(log)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(of(f"{self.path}/log/{n}/_SUCCESS")))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or one of those kept; an empty one before the first."""
        known = self._numbers()
        if not known:
            return Version()
        rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log/v={known[-1] if number is None else number}").collect()
        one = rows[0]
        return Version(one.version, one.batch_id, json.loads(one.marks), {r.bucket: r.location for r in rows if r.location})

    def read(self, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of a version, of some buckets only if these are named; None if it has none."""
        held = self.version() if version is None else version
        places = [p for b, p in held.places.items() if buckets is None or b in set(buckets)]
        return self.spark.read.parquet(*places) if places else None

    def change(self, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], batch_id: int | None = None, marks: dict | None = None, touched: DataFrame | None = None) -> Version:
        """The next version: merge(rows held in the buckets that the batch touches or None, batch) in place of those rows.

        batch_id: a number that grows from batch to batch; one that is not above the last committed changes nothing. marks: kept with
        the version, over those it has. touched: keys whose buckets are rewritten too."""
        held = self.version()
        if batch_id is not None and batch_id <= held.batch_id:
            return held
        keys = batch.select(*self.key) if touched is None else batch.select(*self.key).unionByName(touched.select(*self.key))
        own = [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets` numbers
        places = dict(held.places)
        if own:
            folder = f"{self.path}/rows/{uuid.uuid4().hex}"
            out = merge(self.read(held, own), batch).withColumn("_bucket", self.bucket())
            out.repartition(min(len(own), self.buckets), "_bucket").write.partitionBy("_bucket").parquet(folder)
            fs, of = self._files()
            for b in own:
                place = f"{folder}/_bucket={b}"
                places.pop(b, None)
                if fs.exists(of(place)):
                    places[b] = place
        return self._commit(held, Version(held.number + 1, held.batch_id if batch_id is None else batch_id, {**held.marks, **(marks or {})}, places))

    def _commit(self, held: Version, new: Version) -> Version:
        head = (new.number, new.batch_id, json.dumps(new.marks))
        rows = [(*head, b, p) for b, p in sorted(new.places.items())] or [(*head, None, None)]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/v={new.number}")
        self._clean(new)
        return new

    def _clean(self, new: Version) -> None:
        """Removes versions beyond KEEP and folders of rows that no kept version names."""
        fs, of = self._files()
        known = self._numbers()
        for n in known[:-KEEP]:
            fs.delete(of(f"{self.path}/log/v={n}"), True)
        used = {p.rsplit("/rows/", 1)[1] for n in known[-KEEP:] for p in (new if n == new.number else self.version(n)).places.values()}
        rows = of(f"{self.path}/rows")
        for folder in fs.listStatus(rows) if fs.exists(rows) else []:
            name = folder.getPath().getName()
            parts = [x.getPath().getName() for x in fs.listStatus(folder.getPath())]
            for part in parts:
                if f"{name}/{part}" not in used:
                    fs.delete(of(f"{self.path}/rows/{name}/{part}"), True)
            if not any(f"{name}/{part}" in used for part in parts):
                fs.delete(folder.getPath(), True)


def newest(key: list[str], order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that keeps each key's latest row; what is held loses ties."""
    from tidebar.sources.store import upsert

    return lambda held, batch: upsert(batch.limit(0) if held is None else held.select(*batch.columns), batch, key, order)


def added(key: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that only adds keys which are not held."""
    from tidebar.sources.store import insert_new

    return lambda held, batch: batch.dropDuplicates(key) if held is None else insert_new(held.select(*batch.columns), batch, key)


def without(keys: DataFrame, key: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A merge that removes the keys given; the batch's rows come in."""
    return lambda held, batch: batch if held is None else held.select(*batch.columns).join(keys, key, "left_anti").unionByName(batch)


BAR_KEY = ["symbol", "frequency", "trading_date", "slot"]


def write_official_bars(table: VersionedTable, bars: DataFrame, batch_id: int | None = None) -> Version:
    """Bars (BAR_KEY, row_hash, source_priority and facts) merged into the stored ones: new keys come in, a revision takes the place of a bar
    whose source does not outrank it, everything else stays. Only buckets of the batch's symbols and days are rewritten."""
    from tidebar.operators.bars import merge_bars

    def merge(held: DataFrame | None, batch: DataFrame) -> DataFrame:
        if held is None:
            return batch.withColumn("revision", F.lit(0))
        verdict = merge_bars(held, batch, BAR_KEY).select(*BAR_KEY, F.col("revision").alias("_revision"), F.col("event_type").alias("_event"))
        facts = [c for c in batch.columns if c not in BAR_KEY]
        both = held.select(*BAR_KEY, F.struct(*facts).alias("_old")).join(batch.select(*BAR_KEY, F.struct(*facts).alias("_new")), BAR_KEY, "full").join(verdict, BAR_KEY)
        row = F.when(F.col("_event").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
        return both.select(*BAR_KEY, row.alias("_row"), F.col("_revision").alias("revision")).select(*BAR_KEY, *[F.col(f"_row.{c}").alias(c) for c in facts], "revision")

    return table.change(bars, merge, batch_id)

