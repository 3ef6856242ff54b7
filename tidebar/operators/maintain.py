"""Projection, retention, archive, integrity, pools and notifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of the pool: symbols picked by hand first, then by their strongest active event, those of a strategy before mere discoveries.
MANUAL, POOL_RANK, STRATEGY = 0, {"ESTABLISHED": 1, "FOCUS": 2, "OBSERVING": 3, "DISCOVERED": 5}, 4


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def retain(events: DataFrame, hits: DataFrame, lifecycle: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events last seen from the cutoff on, their hits, their lifecycle rows, how many rows went and stay by dataset)."""
    kept = events.filter(F.col("last_seen_at") >= cutoff)
    own = kept.select("event_key")
    left = {"events": (events, kept), "hits": (hits, hits.join(own, "event_key", "left_semi")), "lifecycle": (lifecycle, lifecycle.join(own, "event_key", "left_semi"))}
    count = lambda rows, name, sign: rows.agg((F.count("*") * sign).alias("n")).select(F.lit(name).alias("dataset"), "n", F.lit(sign < 0).alias("stays"))
    rows = reduce(DataFrame.unionByName, [count(d, name, sign) for name, pair in left.items() for d, sign in zip(pair, (1, -1), strict=True)])
    audit = rows.groupBy("dataset").agg(F.sum("n").alias("removed"), (-F.sum(F.when(F.col("stays"), F.col("n")).otherwise(0))).alias("kept"))
    return kept, left["hits"][1], left["lifecycle"][1], audit


def archive(df: DataFrame, column: str, before: Column, path: str) -> DataFrame:
    """Writes rows before a date as zstd Parquet by date; the manifest of what is there (partition, rows, checksum, first and last date), or
    an error if its rows or checksums are not those of the source: only then may the source be purged."""
    old = df.filter(F.col(column) < before)
    old.write.mode("overwrite").option("compression", "zstd").partitionBy(column).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    manifest = lambda rows: rows.groupBy(column).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
    if not difference(manifest(old), manifest(back), [column]).isEmpty():
        raise RuntimeError("the archive does not hold what its source does")
    return manifest(back).withColumns({"first": F.col(column), "last": F.col(column)})


def reconcile_day(old: DataFrame, new: DataFrame) -> DataFrame:
    """Active events that a recomputation no longer has, invalidated for that reason."""
    gone = old.filter("is_active").join(new.select("event_key"), "event_key", "left_anti")
    return gone.withColumns({"stage": F.lit("INVALIDATED"), "is_active": F.lit(False), "invalidation_reason": F.lit("SOURCE_RECONCILIATION")})


def hot_pool(events: DataFrame, quotes: DataFrame, size: int = 300, shard: int = 50, manual: DataFrame | None = None, strategy: DataFrame | None = None) -> DataFrame:
    """The `size` first symbols by rank, ties by distance of the price to the nearest level; dealt to shards in order. manual, strategy:
    further symbols with their own ranks. Each row has its active levels, the sides they are on and the nearest one."""
    rank = F.coalesce(*[F.when(F.col("strongest_stage") == s, F.lit(r)) for s, r in POOL_RANK.items()])
    near = events.filter("is_active").join(quotes.select("symbol", "price_ticks"), "symbol").select("symbol", "side", "ticks", rank.alias("rank"), F.abs(F.col("ticks") - F.col("price_ticks")).alias("distance"))
    for more, own in ((manual, MANUAL), (strategy, STRATEGY)):
        if more is not None:
            near = near.unionByName(more.select("symbol", F.lit(own).alias("rank")).distinct(), allowMissingColumns=True)
    rows = near.groupBy("symbol").agg(
        F.min("rank").alias("rank"), F.count("ticks").alias("levels"), F.array_join(F.sort_array(F.collect_set("side")), ",").alias("sides"), F.min("distance").alias("distance"),
        F.min_by("ticks", F.when(F.col("ticks").isNotNull(), F.struct("distance", "ticks"))).alias("nearest_ticks"),
    )
    order = ["rank", F.asc_nulls_last("distance"), "symbol"]
    top = rows.orderBy(*order).limit(size)  # at most `size` rows are numbered
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("shard", F.floor((F.col("place") - 1) / shard).cast("int"))


def notifications(lifecycle: DataFrame) -> DataFrame:
    """A card per notifying transition, with a severity."""
    severity = F.when(F.col("to_stage") == "ESTABLISHED", "critical").when(F.col("to_stage").isin("FOCUS", "INVALIDATED"), "warning").otherwise("info")
    return lifecycle.filter("notify").select(F.sha2(F.concat_ws("|", "event_key", "to_stage"), 256).alias("card_id"), "event_key", "symbol", "to_stage", "at", severity.alias("severity"))


def by_rank(df: DataFrame, column: str, ranks: list[str], *then: Column) -> DataFrame:
    order = F.coalesce(*[F.when(F.col(column) == v, F.lit(i)) for i, v in enumerate(ranks)], F.lit(len(ranks)))
    return df.orderBy(order, *then)


def changes_after(df: DataFrame, cursor: int, n: int, column: str = "change_id") -> DataFrame:
    """The next n rows after a cursor, and one more to tell whether there are further ones."""
    return df.filter(F.col(column) > cursor).orderBy(column).limit(n + 1)


def difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose rows differ anywhere, null-safe, or that one side lacks."""
    fields = [c for c in a.columns if c not in key]
    x, y = (d.select(*key, F.struct(*fields).alias(n)) for d, n in ((a, "x"), (b, "y")))
    return x.join(y, key, "full").filter(~F.col("x").eqNullSafe(F.col("y"))).select(*key)
