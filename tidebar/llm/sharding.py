"""Sharding by fixed virtual slots.

A record's id hashes to one of SLOTS virtual slots, for good. Spark adds up the bytes of each slot, and a slot map says
which shard holds which slot. The map is a small table (SLOTS rows a version); editing it is all that rebalancing or
growing does, and only records of the slots that are moved change their shard. Each edit is a new version; the
stored table keeps them all.
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
SHARDS = 24
#: Parts of a slot that are numbered each on its own.
PARTS = 8
#: What a record costs besides its text, in bytes.
OVERHEAD = 8
_MAP = "version int, virtual_slot int, shard int, bytes long"


def slot_of(column, slots: int = SLOTS):
    return F.pmod(F.xxhash64(column), F.lit(slots)).cast("int")


def measured(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    key, text = F.col(id_col), F.col(text_col)
    virtual = F.when(key.isNull(), slot_of(text, slots)).otherwise(slot_of(key, slots))
    return docs.withColumns({"__size": size, "__virtual": virtual, "__part": F.pmod(F.xxhash64(F.lit(1), key, text), F.lit(PARTS)).cast("int")})


def slot_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> dict[int, int]:
    """Bytes of each slot that holds any record; at most `slots` numbers."""
    rows = measured(docs, id_col, text_col, slots).groupBy("__virtual").agg(F.sum("__size").alias("n")).collect()
    return {x["__virtual"]: x["n"] for x in rows}


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 1: slots dealt in turn, before any bytes are known."""
    return [slot % shards for slot in range(slots)]


def rebalance(owner: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """Moves slots from shards above the mean to those below, the largest first, then swaps slots while that narrows the
    gap between the fullest and the emptiest shard. Slots that need not move stay."""
    owner = list(owner)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight.get(slot, 0)
        held[shard].append(slot)
    mean = sum(load) / shards
    spare = []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda x: (-weight.get(x, 0), x)):
            if load[shard] > mean and weight.get(slot, 0) and load[shard] - weight[slot] >= mean - weight[slot]:
                load[shard] -= weight[slot]
                spare.append(slot)
                if load[shard] <= mean:
                    break
    heap = [(load[shard], shard) for shard in range(shards)]
    heapq.heapify(heap)
    for slot in sorted(spare, key=lambda x: (-weight[x], x)):
        full, shard = heapq.heappop(heap)
        owner[slot], load[shard] = shard, full + weight[slot]
        heapq.heappush(heap, (load[shard], shard))
    held = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        held[shard].append(slot)
    open_ = set(range(shards))  # a shard that a single slot overfills is left as it is
    for _ in range(64 * shards):
        if len(open_) < 2:
            break
        high, low = max(open_, key=lambda s: (load[s], s)), min(open_, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        # the best move or swap brings across half the gap
        light = [(weight.get(x, 0), x) for x in held[low]] + [(0, -1)]
        light.sort()
        best = (gap, None)
        at = 0
        for w, x in sorted((weight.get(x, 0), x) for x in held[high]):
            while at + 1 < len(light) and light[at + 1][0] <= w - gap / 2:
                at += 1
            for v, y in light[at : at + 2]:
                rest = abs(gap - 2 * (w - v))
                if 0 < w - v < gap and rest < best[0]:
                    best = (rest, (x, y, w - v))
        if best[1] is None:
            open_.discard(high)
            continue
        x, y, moved = best[1]
        held[high].remove(x)
        held[low].append(x)
        owner[x] = low
        if y >= 0:
            held[low].remove(y)
            held[high].append(y)
            owner[y] = high
        load[high] -= moved
        load[low] += moved
    return owner


def grow(owner: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """One more shard: takes slots from the fullest shards until it holds its share; no slot moves between old shards."""
    owner = list(owner)
    load = [0] * shards
    held = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight.get(slot, 0)
        held[shard].append((weight.get(slot, 0), slot))
    for own in held:
        own.sort()
    share, taken = sum(load) / (shards + 1), 0
    while taken < share:
        shard = max(range(shards), key=lambda s: (load[s], s))
        if not held[shard]:
            break
        w, slot = held[shard].pop(len(held[shard]) // 2)
        if not w:
            continue
        owner[slot] = shards
        load[shard] -= w
        taken += w
    return owner


def save_map(spark: SparkSession, path: str, version: int, owner: list[int], weight: dict[int, int]) -> None:
    """Adds a version to the stored map."""
    rows = [(version, slot, shard, weight.get(slot, 0)) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, shard of each slot); the newest version unless one is named; None if nothing is stored there."""
    try:
        table = spark.read.schema(_MAP).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.filter(F.col("version") == version).collect()
    owner = [0] * len(rows)
    for x in rows:
        owner[x["virtual_slot"]] = x["shard"]
    return version, owner


def assign(docs: DataFrame, owner: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with size, text_crc32, virtual_slot, shard, and slot: the row's place in its shard, gapless from 0.

    A shard's rows are numbered slot by slot, and within a slot part by part (PARTS parts by a hash of the whole record), by id in
    a part, so that no slot is sorted in one task. A null text is empty. Rows with equal ids share a virtual slot and are numbered in any
    order; rows without an id are spread by their text. Other columns are not read."""
    slots = len(owner)
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text"))
    cells = measured(rows, "__key", "__text", slots).select("__key", "__virtual", "__part", "__size", F.crc32(F.coalesce(F.col("__text"), F.lit(""))).alias("text_crc32"))
    counts = {(x["__virtual"], x["__part"]): x["count"] for x in cells.groupBy("__virtual", "__part").count().collect()}  # at most slots * PARTS
    first, before = [], {}
    for slot, shard in enumerate(owner):
        for part in range(PARTS):
            first.append((slot, part, shard, before.get(shard, 0)))
            before[shard] = first[-1][3] + counts.get((slot, part), 0)
    place = F.row_number().over(Window.partitionBy("__virtual", "__part").orderBy("__key", "text_crc32", "__size")) - 1
    table = docs.sparkSession.createDataFrame(first, "slot_id int, part_id int, shard int, base long")
    joined = cells.withColumn("__place", place).join(F.broadcast(table), (F.col("__virtual") == F.col("slot_id")) & (F.col("__part") == F.col("part_id")))
    return joined.select(
        F.col("__key").alias(id_col),
        F.col("__size").alias("size"),
        "text_crc32",
        "shard",
        (F.col("base") + F.col("__place")).cast("long").alias("slot"),
        F.col("__virtual").alias("virtual_slot"),
    )


def shard(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all documents to `shards` shards of nearly equal bytes (text bytes and 8 for each record), with map_version.

    path: the stored map, in a folder that all executors share. An empty one gets versions 1 (slots in turn) and 2 (rebalanced by bytes);
    another gets one more version, which moves only the slots that have to move. The rows follow the version as it is read
    back. No rows in, no rows out."""
    spark = docs.sparkSession
    weight = slot_bytes(docs, id_col, text_col, slots)
    stored = load_map(spark, path)
    if stored is None:
        stored = 1, first_map(shards, slots)
        save_map(spark, path, *stored, weight)
    elif len(stored[1]) != slots:
        raise ValueError(f"the stored map has {len(stored[1])} virtual slots, not {slots}")
    version, owner = stored
    save_map(spark, path, version + 1, rebalance(owner, weight, shards), weight)
    version, owner = load_map(spark, path, version + 1)
    return assign(docs, owner, id_col, text_col).withColumn("map_version", F.lit(version))
