"""What a live job keeps: events, hits and transitions, the projection for grouped queries with its groups, and bars laid out for scans.

All are changed by key in buckets (`versions.VersionedTable`), so a batch costs what it changes; a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators.surface import build_projection, groups
from tidebar.sources import store
from tidebar.sources.versions import Version, VersionedTable, added, newest


class LiveState:
    """events and hits by their newest state, lifecycle rows only added, under one folder; buckets go by event_key."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        table = lambda name: VersionedTable(spark, f"{folder}/{name}", ["event_key"], buckets)
        self.tables = {name: table(name) for name in ("events", "hits", "lifecycle")}
        self.merges = {"events": newest(["event_key"], ["last_seen_at"]), "hits": newest(["hit_key"], ["eob"]), "lifecycle": added(["event_key", "to_stage", "at"])}

    def write(self, batch: dict[str, DataFrame], batch_id: int) -> dict[str, Version]:
        """Each table notes the batch on its own: if the job dies between two, the batch that runs again goes on with those that lack it."""
        return {name: self.tables[name].change(rows, self.merges[name], batch_id) for name, rows in batch.items()}

    def read(self, name: str) -> DataFrame | None:
        return self.tables[name].read()


class LiveProjection:
    """The projection by symbol, and one row a symbol of its groups at a cutoff, kept up to date by what changed."""

    def __init__(self, spark: SparkSession, folder: str, cutoff: Column, buckets: int = 16):
        table = lambda name: VersionedTable(spark, f"{folder}/{name}", ["symbol"], buckets)
        self.rows, self.groups, self.cutoff = table("projection"), table("groups"), cutoff

    def apply(self, changed: DataFrame, gone: DataFrame, batch_id: int) -> None:
        """changed: events as they are now (new or altered); gone: symbol, event_key of events that are no more. Rows of these keys are replaced,
        groups of their symbols are counted anew from the projection's rows of those symbols alone."""
        new = store.staged(build_projection(changed), "projected")
        keys = store.staged(gone.select("symbol", "event_key").unionByName(new.select("symbol", "event_key")).distinct(), "projected-keys")
        touched = keys.select("symbol").distinct()

        def replace(held: DataFrame | None, batch: DataFrame) -> DataFrame:
            return batch if held is None else held.select(*batch.columns).join(keys, ["symbol", "event_key"], "left_anti").select(*batch.columns).unionByName(batch)

        version = self.rows.change(new, replace, batch_id, touched=touched)
        own = [r.b for r in touched.select(self.rows.bucket().alias("b")).distinct().collect()]  # at most as many numbers as buckets
        held = self.rows.read(version, own)
        empty = new.limit(0)
        counted = groups((empty if held is None else held.select(*empty.columns)).join(touched, "symbol", "left_semi"), self.cutoff)
        self.groups.change(counted, lambda old, batch: batch if old is None else old.select(*batch.columns).join(touched, "symbol", "left_anti").unionByName(batch), batch_id, touched=touched)


def store_bars(bars: DataFrame, name: str, buckets: int = 16) -> None:
    """Bars as a table of the warehouse: a folder a frequency, in it buckets by symbol, each sorted by symbol and end. Joins and windows by symbol need
    no exchange, a frequency is a pruned partition."""
    bars.write.mode("overwrite").partitionBy("frequency").bucketBy(buckets, "symbol").sortBy("symbol", "eob").saveAsTable(name)
