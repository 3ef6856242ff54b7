"""Near-duplicates by BagMinHash: weighted Jaccard over multisets of five-word shingles.

A shingle that occurs w times in a text has weight w. The weight axis is cut into the blocks [0, 1), [1, 2), [2, 4), [4, 8) ...;
each (shingle, block) runs a Poisson process of the block's length as rate, the same in every text. A point
has a time, a component of the signature and a place in the block; it counts if its place lies below the text's weight (so
two texts share exactly the points below their smaller weight). A component keeps its earliest time; a process ends
when its time passes the latest of the components. Equal components estimate sum(min) / sum(max) without bias.

Texts with the same words are one class first. The classes' signatures are cut into bands; classes of one band bucket
are candidates, and candidates are verified on the multisets themselves. At first each class meets the most central class of its
buckets (by how many classes share its buckets), which for copies of a text is the text. What is then still apart in a
bucket meets in rounds: all pairs of a small bucket, in a large one a row of each component and one of its largest component,
until a round finds no new link. These rounds only spare work: at last all pairs of a large bucket that are still in different
components are verified, in blocks of two chunks of the bucket. A pair that shares several buckets is verified in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import mix, prefix_hash, ragged, signed, slices, span_hash, staged, words_of
from tidebar.llm.components import components, merged

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8**6)**36 = 2e-5; one of 0.3 shares one with 0.03.
BANDS, ROWS = 36, 6
#: Buckets up to this size give all pairs between components (at most 3.5 a class).
SMALL = 8
#: Rounds go on until one finds no new link, at most so many; the pairs they leave are verified in blocks.
ROUNDS = 4
#: Wanted classes and shingles of a chunk of a large bucket.
CHUNK, CHUNK_SHINGLES = 512, 1 << 17


def shingles(words: np.ndarray, rows: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each shingle; a text of fewer words is one shingle, an empty one has none."""
    n = np.diff(rows)
    prefix = prefix_hash(words)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return span_hash(prefix, start, np.minimum(start + size, rows[row + 1])), row


def multiset(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key of hash and row, hash, row, count) of the distinct shingles of each row."""
    key, first, count = np.unique(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    return key, hashes[first], row[first], count


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(element: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Earliest times, rows x size; inf in rows without elements."""
    best = np.full(rows * size, np.inf)
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64), 0) + 1
    block = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    key = mix(np.repeat(element, blocks) + mix(block.astype(np.uint64)))
    doc, top = np.repeat(row, blocks), np.repeat(weight, blocks)
    floor = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    length = np.maximum(floor, 1)
    time = np.zeros(len(key))
    latest = np.full(rows, np.inf)
    step = 0
    while len(key):
        step += 1
        draw = mix(key + np.uint64(step * 0xA0761D6478BD642F % (1 << 64)))
        time = time - np.log(_unit(draw)) / length
        live = time < latest[doc]
        key, doc, top, floor, length, time, draw = (x[live] for x in (key, doc, top, floor, length, time, draw))
        more = mix(draw ^ np.uint64(0xE7037ED1A0B428DB))
        place = floor + (((more >> np.uint64(32)) * length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = place < top
        at = doc[counts] * size + ((more[counts] & np.uint64(0xFFFFFFFF)) % np.uint64(size)).astype(np.int64)
        np.minimum.at(best, at, time[counts])
        latest = best.reshape(rows, size).max(axis=1)
    return best.reshape(rows, size)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, cuts, _ = words_of(part.column("text"), plain=True)
            n = part.num_rows
            hashes, row = shingles(words, cuts)
            _, element, doc, count = multiset(hashes, row)
            sign = signatures(element, doc, count, n, bands * rows).view(np.uint64).reshape(n, bands, rows)
            key = np.zeros((n, bands), np.uint64)
            for i in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sign[:, :, i] + np.arange(bands, dtype=np.uint64))
            whole, again = prefix_hash(words), prefix_hash(mix(words))
            full = np.flatnonzero(np.diff(cuts))
            first, last = (np.zeros(n, np.uint64) for _ in range(2))
            first[full], last[full] = span_hash(whole, cuts[full], cuts[full + 1]), span_hash(again, cuts[full], cuts[full + 1])
            size = np.bincount(row, minlength=n)
            offsets = np.append(0, np.cumsum(np.where(size > 0, bands, 0)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(signed(first)), pa.array(signed(last)), pa.array(size, pa.int64()), ragged(signed(key[size > 0].ravel()), offsets, pa.int64())],
                ["id", "h1", "h2", "size", "bands"],
            )

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], "text_a"):
            sets = []
            for column in ("text_a", "text_b"):
                words, cuts, _ = words_of(part.column(column), plain=True)
                sets.append(multiset(*shingles(words, cuts)))
            n = part.num_rows
            _, i, j = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True, return_indices=True)
            common = np.bincount(sets[0][2][i], np.minimum(sets[0][3][i], sets[1][3][j]), n)
            total = sum(np.bincount(s[2], s[3], n) for s in sets)
            similarity = common / np.maximum(total - common, 1)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarity, pa.float64())], ["a", "b", "similarity"])


def _first_pairs(held: DataFrame) -> DataFrame:
    """Each class with the most central one in its buckets; ties go to the smaller id."""
    centre = held.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("c"))).alias("centre"))
    best = held.join(centre, "key").groupBy("id").agg(F.min("centre").alias("centre"))
    c = F.col("centre.c")
    return best.filter(F.col("id") != c).select(F.least("id", c).alias("a"), F.greatest("id", c).alias("b")).distinct()


def _next_pairs(held: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """Pairs of buckets that are not one component yet: all between components of a small one (in the first turn, which settles
    it), in a large one a row of each component with one of the largest, drawn anew for each bucket and turn."""
    named = held.join(label, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    draw = F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("draw"), F.col("id").alias("id"))
    each = named.groupBy("key", "component").agg(F.max(draw).alias("one"), F.count("*").alias("n"))
    sizes = each.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.max(F.struct("n", "one")).alias("most")).filter("parts > 1")
    centre = F.col("most.one.id")
    stars = each.join(sizes.filter(F.col("n") > SMALL).select("key", "most"), "key").filter(F.col("one.id") != centre)
    pairs = stars.select(F.least("one.id", centre).alias("a"), F.greatest("one.id", centre).alias("b"))
    if turn == 1:
        few = named.join(sizes.filter(F.col("n") <= SMALL).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "component"))).alias("rows"))
        two = few.select(F.posexplode("rows").alias("at", "x"), "rows").select("x", F.explode(F.expr("slice(rows, at + 2, size(rows))")).alias("y"))
        pairs = pairs.union(two.filter("x.component <> y.component").select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: id, component_id (smallest id of its near-duplicates, itself included), copy_of (smallest id of the
    texts with the same words), kept (id = component_id).

    Words are lower-cased letters and digits; a text of one to four words is one shingle. A null or empty text, or one
    without words, is like no other. Ids are of any type that has an order; rows with equal ids are one document, all of whose texts count; rows without an
    id are kept, with null component_id. Ties: the smallest id. Other columns are not read. No rows in, no rows out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed_docs = staged(texts.mapInArrow(_sign(bands, rows), f"id {kind}, h1 long, h2 long, size long, bands array<long>"), "signatures")
    full = signed_docs.filter("size > 0")
    classes = staged(full.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.first("bands").alias("bands"), F.first("size").alias("size")), "classes")
    spread = classes.select(F.explode("bands").alias("key"), F.col("class_id").alias("id"))
    busy = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows_in = spread.join(busy, "key")
    score = rows_in.groupBy("id").agg(F.sum("n").alias("score"))
    held = staged(rows_in.select("key", "id").join(score, "id"), "bands")
    tried = staged(_verified(_first_pairs(held), texts), "verified")
    alike = lambda pairs: pairs.filter(F.col("similarity") >= threshold - 1e-12).select("a", "b")
    label = components(alike(tried))
    for turn in range(1, ROUNDS + 1):
        pairs = _next_pairs(held, label, turn).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        checked = staged(_verified(pairs, texts), "verified")
        links = alike(checked)
        if links.isEmpty():
            break
        label, tried = merged(label, links), tried.union(checked)
    rest = _rest(held, classes, label, texts, threshold)
    if rest is not None:
        label = merged(label, rest)
    same = full.join(classes.select("h1", "h2", "class_id"), ["h1", "h2"]).select("id", "class_id")
    same = same.join(label, F.col("class_id") == F.col("node"), "left").select("id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    # one document is one row here, whatever its rows
    same = same.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    ids = docs.select(F.col(id_col).alias("__doc"))
    out = ids.join(same, F.col("__doc") == F.col("id"), "left")
    return out.select(
        F.col("__doc").alias(id_col),
        F.coalesce("component_id", "__doc").alias("component_id"),
        F.coalesce("class_id", "__doc").alias("copy_of"),
        F.coalesce(F.coalesce("component_id", "__doc") == F.col("__doc"), F.lit(True)).alias("kept"),
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Similarity of pairs, from their texts."""
    kind = pairs.schema["a"].dataType.simpleString()
    a = texts.select(F.col("id").alias("ia"), F.col("text").alias("text_a"))
    b = texts.select(F.col("id").alias("ib"), F.col("text").alias("text_b"))
    full = pairs.join(a, F.col("a") == F.col("ia")).select("a", "b", "text_a").join(b, F.col("b") == F.col("ib")).select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_overlap, f"a {kind}, b {kind}, similarity double")


def _rest(held: DataFrame, classes: DataFrame, label: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """Links (a, b) between components that share a large bucket, from all pairs that it holds; None without such pairs."""
    kind = held.schema["id"].dataType.simpleString()
    facts = classes.select(F.col("class_id").alias("id"), "bands", "size").join(label, F.col("id") == F.col("node"), "left")
    facts = facts.select("id", "bands", "size", F.coalesce("component", "id").alias("component"))
    rows = held.select("key", "id").distinct().join(facts, "id")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"))
    sizes = sizes.filter((F.col("n") > SMALL) & (F.col("low") < F.col("high")))
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    dealt = rows.join(sizes.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.expr("transform(sequence(0, chunks - 1), o -> struct(least(chunk, o) AS i, greatest(chunk, o) AS j))"))
    blocks = dealt.withColumn("pair", other).select("key", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "chunk", "id", "bands", "size", "component")
    # texts go only where a pair needs them
    needed = staged(blocks.groupBy("key", "i", "j").applyInPandas(_needed(threshold), f"key long, i int, j int, chunk int, id {kind}, bands array<long>, component {kind}"), "needed")
    if needed.isEmpty():
        return None
    full = needed.join(texts, "id")
    return staged(full.groupBy("key", "i", "j").applyInPandas(_block_links(threshold), f"a {kind}, b {kind}"), "rest")


def _partners(block: pd.DataFrame):
    """A function of row and components: the later rows that the row has to meet in this block."""
    key, i, j = (int(block[c].iloc[0]) for c in ("key", "i", "j"))
    bands, chunk = np.stack(block["bands"].to_numpy()), block["chunk"].to_numpy()
    at = np.arange(len(block))

    def run(row: int, component: np.ndarray) -> np.ndarray:
        others = np.flatnonzero((component != component[row]) & ((at > row) if i == j else (chunk != chunk[row]) & (chunk[row] == i)))
        equal = bands[others] == bands[row]
        return others[bands[row][equal.argmax(axis=1)] == key]  # an earlier common bucket has the pair

    return run


def _needed(threshold: float):
    """Rows of a block that have a pair to verify: in different components, and not too different in size for a link."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        partners = _partners(block)
        size, component = block["size"].to_numpy(np.float64), pd.factorize(block["component"])[0]
        need = np.zeros(len(block), bool)
        for row in range(len(block)):
            others = partners(row, component)
            others = others[np.minimum(size[others], size[row]) >= (threshold - 1e-9) * np.maximum(size[others], size[row])]
            need[others] = True
            need[row] |= len(others) > 0
        return block.loc[need, ["key", "i", "j", "chunk", "id", "bands", "component"]]

    return run


def _block_links(threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        partners = _partners(block)
        elements = []
        start = 0
        for part in slices([pa.RecordBatch.from_arrays([pa.array(block["text"], pa.string())], ["text"])]):
            words, cuts, _ = words_of(part.column("text"), plain=True)
            _, hashes, row, count = multiset(*shingles(words, cuts))
            elements.append((hashes, row + start, count))
            start += part.num_rows
        hashes, owner, count = (np.concatenate(x) for x in zip(*elements))
        order = np.argsort(owner, kind="stable")
        owner, count = owner[order], count[order]
        code = np.unique(hashes, return_inverse=True)[1][order]
        cuts = np.searchsorted(owner, np.arange(len(block) + 1))
        size = np.bincount(owner, count, len(block))
        component, weight = pd.factorize(block["component"])[0], np.zeros(len(hashes), np.int64)
        a, b = [], []
        for row in range(len(block)):
            others = partners(row, component)
            others = others[np.minimum(size[others], size[row]) >= (threshold - 1e-9) * np.maximum(size[others], size[row])]
            if not len(others):
                continue
            own = slice(cuts[row], cuts[row + 1])
            weight[code[own]] = count[own]
            wanted = np.zeros(len(block), bool)
            wanted[others] = True
            pick = wanted[owner]
            common = np.bincount(owner[pick], np.minimum(weight[code[pick]], count[pick]), len(block))[others]
            weight[code[own]] = 0
            for other in others[common / np.maximum(size[others] + size[row] - common, 1) >= threshold - 1e-12].tolist():
                if component[other] != component[row]:
                    component[component == component[other]] = component[row]
                    a.append(row)
                    b.append(other)
        ids = block["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]}) if a else pd.DataFrame({"a": ids[:0], "b": ids[:0]})

    return run
