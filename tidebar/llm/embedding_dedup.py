"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits the vectors by a random direction at the median of their projections, again and again. A vector close to a
split (within SPILL of a link's reach) goes to both sides, so two linked vectors seldom part; over TREES trees they
meet in some leaf. Leaves are compared in blocks of at most BLOCK rows: a leaf that grew larger is cut into chunks and
every two chunks meet, so no leaf is capped.

The upper splits are fitted on a bounded sample; every vector is indexed. A leaf that holds many rows of one label is then split
further, by a tree of its own that is fitted in a task on a bounded sample of the leaf, and so on until leaves are small or cannot be
split, so leaves stay small however many vectors there are. Equal vectors of one label are one class with a
multiplicity, so copies cost nothing. A block sends no pairs: it counts, for each class, the links that no earlier leaf
has already seen (each row carries its leaves in all trees), and joins each class to the smallest one that the block's
verified pairs reach, which keeps every connection and is one row a class. Vectors of each length have a forest and leaves of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import bounded_sample, give_back, mix, staged
from tidebar.llm.components import components

THRESHOLD = 0.98
TREES = 8
#: Rows of the sample that the splits are fitted on, and the least of them in a node that is split.
SAMPLE_ROWS, SPLIT_ROWS = 20_000, 32
#: Wanted classes in a leaf, and the most that one task compares with one another at once.
LEAF, BLOCK = 256, 1024
#: A leaf with more classes of a label is split further, by a tree fitted on about so many of them; rows that descend it in one task.
OVERFULL, LEAF_SAMPLE, DESCENT = 4096, 2048, 4096
#: Leaf numbers have so many bits, the tree's number stands above them.
SHIFT = 48
#: Half-width of the band in which a vector goes to both sides, in typical projections of a link's difference.
SPILL = 1.0


def fit_tree(sample: np.ndarray, depth: int, margin: float, rng: np.random.Generator) -> list[tuple[np.ndarray, float, int, int]]:
    """Nodes (direction, split, left, right) in order; a child < 0 is leaf -child - 1."""
    nodes: list = []
    leaves = 0
    todo = [(np.arange(len(sample)), depth, None, 0)]
    while todo:
        rows, deep, parent, side = todo.pop()
        split = None
        if deep and len(rows) >= SPLIT_ROWS:
            direction = rng.standard_normal(sample.shape[1])
            direction /= np.linalg.norm(direction)
            along = sample[rows] @ direction
            middle = float(np.median(along))
            left, right = rows[along <= middle + margin], rows[along > middle - margin]
            if max(len(left), len(right)) <= 0.9 * len(rows):  # else all lie within a link's reach: a leaf
                split = (direction, middle)
        if split is None:
            leaves += 1
            number = -leaves
        else:
            number = len(nodes)
            nodes.append([*split, 0, 0])
            todo += [(left, deep - 1, number, 2), (right, deep - 1, number, 3)]
        if parent is not None:
            nodes[parent][side] = number
    return [tuple(n) for n in nodes]


def leaves_of(vectors: np.ndarray, tree: list, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a row falls into."""
    rows, leaf = [], []
    todo = [(0 if tree else -1, np.arange(len(vectors)))]
    while todo:
        node, own = todo.pop()
        if not len(own):
            continue
        if node < 0:
            rows.append(own)
            leaf.append(np.full(len(own), -node - 1))
            continue
        direction, middle, left, right = tree[node]
        along = vectors[own] @ direction
        todo += [(left, own[along <= middle + margin]), (right, own[along > middle - margin])]
    return (np.concatenate(rows), np.concatenate(leaf)) if rows else (np.zeros(0, int), np.zeros(0, int))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_numpy(zero_copy_only=False).tolist() if isinstance(column, pa.Array) else column.tolist(), np.float64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _index(forests: dict[int, tuple[list, float]]):
    """Leaf paths of each class: an array of leaves per tree, flattened as tree * 2**SHIFT + leaf.

    forests: trees and margin by length of vector; a length without trees is one leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            lengths = batch.column("length").to_numpy()
            row, leaf = [], []
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                vectors = _unit(_matrix(column.take(pa.array(own))))
                forest, margin = forests.get(length, ([[]], 0.0))
                for number, tree in enumerate(forest):
                    r, leaf_number = leaves_of(vectors, tree, margin)
                    row.append(own[r])
                    leaf.append(leaf_number + (number << SHIFT))
            row, leaf = np.concatenate(row), np.concatenate(leaf)
            order = np.lexsort((leaf, row))
            offsets = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaf[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"])
        give_back()

    return run


def _split(threshold: float, leaf: int):
    """The tree of one overfull leaf, from a sample of it; nothing if the leaf cannot be split."""

    def run(sample: pd.DataFrame) -> pd.DataFrame:
        first = sample.iloc[0]
        vectors = _unit(_matrix(sample["vector"]))
        rng = np.random.default_rng([int(first["leaf"]), len(vectors[0])])
        depth = max(1, int(np.ceil(np.log2(first["n"] / leaf))))
        nodes = fit_tree(vectors, depth, margin_of(vectors.shape[1], threshold), rng)
        columns = ["label", "length", "leaf"]
        out = sample[columns].head(1 if nodes else 0).copy()
        out["directions"] = [np.concatenate([n[0] for n in nodes]).tobytes()] if nodes else []
        out["splits"] = [np.array([n[1] for n in nodes])] if nodes else []
        out["children"] = [np.array([n[2:] for n in nodes], np.int32).ravel()] if nodes else []
        # a leaf that no split divides gives no row, whose columns have to be typed all the same
        return out if nodes else out.astype({c: object for c in ("directions", "splits", "children")})

    return run


def _descend(threshold: float):
    """The new leaves of rows of an overfull leaf; without a tree the leaf itself."""

    def run(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(trees):
            return pd.DataFrame({"id": rows["id"][:0], "key": rows["key"][:0], "leaf": [], "into": []})
        vectors, tree = _unit(_matrix(rows["vector"])), trees.iloc[0]
        directions = np.frombuffer(tree["directions"], np.float64).reshape(len(tree["splits"]), -1)
        nodes = [(d, m, *c) for d, m, c in zip(directions, tree["splits"], np.asarray(tree["children"]).reshape(-1, 2).tolist(), strict=True)]
        row, number = leaves_of(vectors, nodes, margin_of(vectors.shape[1], threshold))
        old = int(tree["leaf"])
        new = (mix(np.uint64(old) * np.uint64(31) + number.astype(np.uint64) + np.uint64(1)) >> np.uint64(64 - SHIFT)).astype(np.int64) | (old >> SHIFT << SHIFT)
        return pd.DataFrame({"id": rows["id"].to_numpy()[row], "key": rows["key"].to_numpy()[row], "leaf": old, "into": new})

    return run


def margin_of(length: int, threshold: float) -> float:
    """A link spans at most sqrt(2 - 2 threshold); along a random direction about that over sqrt(length)."""
    return SPILL * np.sqrt((2 - 2 * threshold) / length) / 2


def _refined(indexed: DataFrame, threshold: float, leaf: int, overfull: int) -> DataFrame:
    """indexed with leaves of more than `overfull` classes of a label split, level by level; leaves that cannot be split stay."""
    group = ["label", "length", "leaf"]
    kinds = {f.name: f.dataType.simpleString() for f in indexed.schema.fields}
    shape = f"label {kinds['label']}, length int, leaf long"
    tried = None
    while True:
        big = indexed.select("label", "length", F.explode("leaves").alias("leaf")).groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > overfull)
        if tried is not None:
            big = big.join(tried, group, "left_anti")
        big = staged(big, "overfull")
        if big.isEmpty():
            return indexed
        tried = big.select(*group) if tried is None else tried.unionByName(big.select(*group))
        each = indexed.select("label", "length", "id", F.xxhash64("vector").alias("key"), "vector", F.explode("leaves").alias("leaf")).join(big, group)
        draw = F.pmod(F.xxhash64("leaf", "id", "key"), F.lit(1 << 31))
        sample = each.filter(draw < (1 << 31) * LEAF_SAMPLE / F.col("n")).select(*group, "n", "vector")
        trees = staged(sample.groupBy(*group).applyInPandas(_split(threshold, leaf), f"{shape}, directions binary, splits array<double>, children array<int>"), "leaf-trees")
        # a leaf's rows descend in chunks, and each chunk gets the tree
        chunks = F.ceil(F.col("n") / DESCENT).cast("int")
        rows = each.select(*group, F.pmod(F.xxhash64("id", "key"), chunks).cast("int").alias("chunk"), "id", "key", "vector")
        parts = big.select(*[F.col(c).alias(f"of_{c}") for c in group], F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
        same = [F.col(c) == F.col(f"of_{c}") for c in group]
        dealt = trees.join(parts, same).select(*group, "chunk", "directions", "splits", "children")
        part = [*group, "chunk"]
        moved = rows.groupBy(*part).cogroup(dealt.groupBy(*part)).applyInPandas(_descend(threshold), f"id {kinds['id']}, key long, leaf long, into long")
        moved = moved.groupBy("id", "key").agg(F.collect_set("leaf").alias("old"), F.collect_set("into").alias("new"))
        at = indexed.withColumn("key", F.xxhash64("vector")).join(moved.withColumnsRenamed({"id": "of", "key": "of_key"}), (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
        leaves = F.when(F.col("new").isNull(), F.col("leaves")).otherwise(F.array_sort(F.array_union(F.array_except("leaves", "old"), F.col("new"))))
        indexed = staged(at.withColumn("leaves", leaves).select(*indexed.columns), "leaves")


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches, once pairs x, y are added to those that led to root."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _compare(threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        leaf_i, leaf_j = int(block["i"].iloc[0]), int(block["j"].iloc[0])
        block = block.sort_values("id", kind="stable")
        unit = _unit(_matrix(block["vector"]))
        left = (block["chunk"] == leaf_i).to_numpy()
        right = (block["chunk"] == leaf_j).to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        shared = _paths(block["leaves"], int(block["leaf"].iloc[0]))
        many = block["many"].to_numpy(np.int64)
        links = np.zeros(len(block), np.int64)
        root, met = np.arange(len(block)), np.zeros(len(block), bool)
        for start in range(0, len(a), 256):
            own = a[start : start + 256]
            x, y = np.nonzero(unit[own] @ unit[b].T >= threshold - 1e-9)
            x, y = own[x], b[y]
            keep = (x < y) if leaf_i == leaf_j else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            exact = np.einsum("ij,ij->i", unit[x], unit[y])
            x, y = x[exact >= threshold], y[exact >= threshold]
            met[x] = met[y] = True
            root = _joined(root, x, y)
            fresh = ~_meet(shared, x, y)
            x, y = x[fresh], y[fresh]
            links += np.bincount(x, many[y], len(block)).astype(np.int64) + np.bincount(y, many[x], len(block)).astype(np.int64)
        ids = block["id"].to_numpy()
        return pd.DataFrame({"id": ids[met], "links": links[met], "mate": ids[root[met]]})

    return run


def _paths(leaves: pd.Series, below: int) -> list[np.ndarray]:
    """For each tree, rows x their leaves under `below` in the order of all leaves; -1 where a row has fewer."""
    owner = np.repeat(np.arange(len(leaves)), leaves.map(len))
    flat = np.concatenate(leaves.to_numpy())
    out = []
    for tree in range((below >> SHIFT) + 1):
        own = (flat < below) & (flat >> SHIFT == tree)
        row = owner[own]
        if len(row):
            place = np.arange(len(row)) - np.searchsorted(row, row)
            table = np.full((len(leaves), place.max() + 1), -1, np.int64)
            table[row, place] = flat[own]
            out.append(table)
    return out


def _meet(paths: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs share a leaf that comes before this one, which has counted them."""
    out = np.zeros(len(x), bool)
    for table in paths:
        for start in range(0, len(x), 1 << 15):
            part = slice(start, start + (1 << 15))
            p, q = table[x[part]], table[y[part]]
            out[part] |= ((p[:, :, None] == q[:, None, :]) & (p[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, seed: int = 7, sample_rows: int = SAMPLE_ROWS, overfull: int = OVERFULL) -> DataFrame:
    """One row per vector: id, n_links (other vectors of its label with cosine >= threshold), component_id (smallest id that links
    reach), kept (id = component_id).

    Vectors without a label, null, empty, zero or with null or non-finite numbers link with nothing; vectors of different lengths do
    not link with one another. Rows with equal ids are told apart while linking, and share component_id. Other columns are not
    read. No rows in, no rows out.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
    finite = ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = rows.filter(good & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda v: v != 0.0))
    classes = usable.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count("*").alias("many"))
    classes = staged(classes, "vectors")
    if classes.isEmpty():
        return vectors.select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    classes = classes.withColumn("length", F.size("vector"))
    points: dict[int, list] = {}
    for x in bounded_sample(classes.select("vector", "id"), ["id"], sample_rows).collect():
        points.setdefault(len(x["vector"]), []).append(x["vector"])
    # fewer are not split, so such a length is one leaf, whose chunks all meet
    points = {length: p for length, p in points.items() if len(p) >= SPLIT_ROWS}
    sizes = classes.filter(F.col("length").isin(list(points))).groupBy("length").agg(F.count("*").alias("rows"), F.count_distinct("label").alias("labels")).orderBy("length").collect() if points else []
    rng = np.random.default_rng(seed)
    forests = {}
    for size in sizes:
        sample = _unit(np.array(points[size["length"]], np.float64))
        margin = margin_of(size["length"], threshold)
        depth = max(0, int(np.ceil(np.log2(size["rows"] / size["labels"] / leaf)))) if size["rows"] > leaf else 0
        # without splits all trees are the same single leaf
        forests[size["length"]] = ([fit_tree(sample, depth, margin, rng) for _ in range(trees if depth else 1)], margin)
    indexed = staged(classes.mapInArrow(_index(forests), f"label {classes.schema['label'].dataType.simpleString()}, vector array<double>, id {kind}, many long, length int, leaves array<long>"), "leaves")
    indexed = _refined(indexed, threshold, leaf, overfull)
    dealt = indexed.withColumn("leaf", F.explode("leaves"))
    counts = indexed.select("label", "length", F.explode("leaves").alias("leaf")).groupBy("label", "length", "leaf").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("chunks"))
    dealt = dealt.join(counts, ["label", "length", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.expr("transform(sequence(0, chunks - 1), o -> struct(least(chunk, o) AS i, greatest(chunk, o) AS j))"))
    blocks = dealt.withColumn("pair", other).select("label", "length", "leaf", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "chunk", "id", "many", "vector", "leaves")
    found = staged(blocks.groupBy("label", "length", "leaf", "i", "j").applyInPandas(_compare(threshold), f"id {kind}, links long, mate {kind}"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("id").alias("a"), F.col("mate").alias("b")).filter("a <> b"))
    classed = classes.select("label", "vector", F.col("id").alias("class_id"), "many")
    facts = (
        classed.join(links, F.col("class_id") == F.col("id"), "left").drop("id").join(label, F.col("class_id") == F.col("node"), "left")
        .select("label", "vector", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "class_id").alias("component"))
    )
    member = usable.join(facts, ["label", "vector"]).groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select(F.col(id_col).alias("__id")).join(member, F.col("__id") == F.col("id"), "left")
    component = F.coalesce("component", "__id")
    return out.select(F.col("__id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("__id"), F.lit(True)).alias("kept"))
