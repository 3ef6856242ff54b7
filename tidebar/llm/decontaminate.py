"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents.

Each item is cut into windows of `size` words (one shorter window if the item has fewer). A window's words are ordered by
rarity in the corpus (occurrences over all documents, counted by Spark). With containment 1 a window of s words needs a
prefix of s - s + 1 = 1 word: a document that holds the window holds its rarest word. Windows are a table with
that word, its place and all their words; a document's words that can be such a word are joined to it, each with the words around it. The
place says where the window would begin (positional bound: inside the document) and end (length bound: the window's size has to fit); only
then are the words compared, one by one.

Which of a document's words go into the join is decided by bitmaps of prefix words and of whole windows, of at most MAX_BITS bits each; the more
windows there are, the more words are joined in vain, and none is missed. Nothing else of the benchmark leaves Spark's tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import Bitmap, bitmap, prefix_hash, ragged, signed, slices, span_hash, staged, words_of

SIZE = 10
#: Bits of a bitmap that goes to the tasks (8 MB).
MAX_BITS = 1 << 26


def _windows(size: int):
    """Windows of benchmark items: item_id, h (hash of the window), words (hash of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, rows, _ = words_of(part.column("text"), plain=True)
            n = np.diff(rows)
            length = np.minimum(n, size)
            many = np.where(n > 0, n - length + 1, 0)
            item = np.repeat(np.arange(len(n)), many)
            start = rows[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            own = length[item]
            cuts = np.append(0, np.cumsum(own))
            flat = words[np.repeat(start - cuts[:-1], own) + np.arange(cuts[-1])] if len(item) else words[:0]
            h = span_hash(prefix_hash(words), start, start + own) if len(item) else words[:0]
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(item)), pa.array(signed(h)), ragged(signed(flat), cuts, pa.int64())], ["item_id", "h", "words"])

    return run


def _count(asked):
    """Occurrences of the words in a bitmap: word, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in slices(batches):
            found, _, _ = words_of(part.column("text"), plain=True)
            found, times = np.unique(found[asked.value.has(found)], return_counts=True)
            words, back = np.unique(np.concatenate([words, found]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, times]), len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n)], ["word", "n"])

    return run


def _hits(told, size: int):
    """Per document: words, and of those that may be the rarest of a window the hash (word), the words before it as far as a window
    reaches (lead), and those words, itself and the words after it (around)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rare, whole = told.value
        for part in slices(batches):
            words, rows, _ = words_of(part.column("text"), plain=True)
            total, prefix = len(words), prefix_hash(words)
            doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            near = np.zeros(total + 1, np.int64)
            for s in sizes:
                if total >= s:
                    begin = np.arange(total - s + 1)
                    begin = begin[doc[begin] == doc[begin + s - 1]]
                    begin = begin[whole.has(span_hash(prefix, begin, begin + s))]
                    near += np.bincount(begin, minlength=total + 1) - np.bincount(begin + s, minlength=total + 1)
            at = np.flatnonzero(np.cumsum(near)[:total] > 0)
            at = at[rare.has(words[at])]
            first, last = np.maximum(at - size + 1, rows[doc[at]]), np.minimum(at + size, rows[doc[at] + 1])
            cuts = np.append(0, np.cumsum(last - first))
            around = words[np.repeat(first - cuts[:-1], last - first) + np.arange(cuts[-1])] if len(at) else words[:0]
            places = at - rows[doc[at]]
            per_row = np.searchsorted(doc[at], np.arange(len(rows)))
            hits = pa.StructArray.from_arrays([pa.array(signed(words[at])), pa.array(places.astype(np.int32)), pa.array((at - first).astype(np.int32)), ragged(signed(around), cuts, pa.int64())], ["word", "place", "lead", "around"])
            yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("__id"), pa.array(np.diff(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), hits)], ["__row", "__id", "n_words", "hits"])

    return run


def _verdict():
    """Hit words, items and their digest of rows with spans (begins, ends) and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            begins, ends, items = (part.column(c).to_pylist() for c in ("begins", "ends", "items"))
            n_hit, n_items, digest = [], [], []
            for a, b, own in zip(begins, ends, items, strict=True):
                total, reach = 0, 0
                for x, y in sorted(zip(a, b, strict=True)):
                    total += max(0, y - max(x, reach))
                    reach = max(reach, y)
                names = sorted(set(own))
                n_hit.append(total)
                n_items.append(len(names))
                digest.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [part.column("__row"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())],
                ["__row", "n_hit", "n_items", "items_sha256"],
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """One row per document: all its columns, n_words, n_hit (words inside an occurrence of a benchmark window), n_items
    (items with an occurring window), items_sha256 (of those item ids, sorted as strings and comma-joined), contaminated.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. benchmark: item_id (of any type, compared as text), text; items without words or id
    are no items, equal items both count. keep: the columns of docs to return (all). A null or empty text has no words and is clean. An empty benchmark makes all
    documents clean. Repeated documents get a row each, documents that share an id but not a text each their own; columns of docs with a result's name give way.
    """
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    texts = docs.select(F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    owned = staged(items.mapInArrow(_windows(size), "item_id string, h long, words array<long>").distinct(), "benchmark-windows")
    windows = owned.select("h", "words").distinct()
    # the rarest word of each window, the first of them if several are as rare
    inside = windows.select("words", F.posexplode("words").alias("o", "word"))
    asked = spark.sparkContext.broadcast(bitmap(inside.select("word").distinct(), "word", MAX_BITS))
    counts = texts.mapInArrow(_count(asked), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    ranked = inside.join(counts, "word", "left").groupBy("words").agg(F.min_by(F.struct("word", "o"), F.struct(F.coalesce("n", F.lit(0)), "o")).alias("p"))
    prefixes = staged(ranked.select("words", "p.word", "p.o"), "benchmark-prefixes")
    sizes = [r.s for r in windows.select(F.size("words").alias("s")).distinct().collect()]  # at most `size` numbers
    told = spark.sparkContext.broadcast((sizes, bitmap(prefixes.select("word").distinct(), "word", MAX_BITS), bitmap(windows.select("h"), "h", MAX_BITS)))
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("__none"))
    keyed = docs.select(F.monotonically_increasing_id().alias("__row"), row.alias("__id"), F.col(text_col).alias("text"))
    hit = "array<struct<word: bigint, place: int, lead: int, around: array<bigint>>>"
    found = staged(keyed.mapInArrow(_hits(told, size), f"__row long, __id {row_type(keyed)}, n_words long, hits {hit}"), "benchmark-hits")

    tried = found.select("__row", F.explode("hits").alias("x")).select("__row", "x.*").join(prefixes, "word")
    fits = (F.col("lead") >= F.col("o")) & (F.slice("around", F.greatest(F.col("lead") - F.col("o") + 1, F.lit(1)), F.size("words")) == F.col("words"))
    exact = staged(tried.filter(fits).select("__row", (F.col("place") - F.col("o")).alias("begin"), (F.col("place") - F.col("o") + F.size("words")).alias("end"), "words").distinct(), "benchmark-matches")
    spans = exact.select("__row", "begin", "end").distinct().groupBy("__row").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    named = exact.select("__row", "words").distinct().join(owned.select("words", "item_id"), "words").select("__row", "item_id").distinct().groupBy("__row").agg(F.collect_list("item_id").alias("items"))
    judged = spans.join(named, "__row").mapInArrow(_verdict(), "__row long, n_hit long, n_items long, items_sha256 string")
    none = [F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(hashlib.sha256(b"").hexdigest()).alias("items_sha256")]
    clean = found.filter("size(hits) = 0").select("__id", "n_words", *none)
    rest = found.filter("size(hits) > 0").select("__row", "__id", "n_words").join(judged, "__row", "left")
    rest = rest.select("__id", "n_words", *[F.coalesce(F.col(c), n).alias(c) for c, n in zip(("n_hit", "n_items", "items_sha256"), none)])
    done = clean.unionByName(rest).withColumn("contaminated", F.col("n_hit") > 0)
    return done.select(*[F.col(f"__id.`{c}`").alias(c) for c in kept], *made)


def row_type(df: DataFrame, column: str = "__id") -> str:
    return df.schema[column].dataType.simpleString()
