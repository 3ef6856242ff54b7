"""Source divergence audit over a minimal acyclic transducer.

Which terms a language keeps is counted first. Its kept terms, sorted, become minimal acyclic transducers, each over a range of at most BLOCK
terms, built state by state from the sorted terms: a path spells a term, the numbers along its edges add up to the term's place in
the range, so place and range give its ordinal in the language. All texts are then streamed through the transducers and counted again by
(lang, source, ordinal): the words of a slice step through the edges together, a character at a time. Ordinals rank terms of equal value.

Counts become probabilities in whole numbers; sources are compared over blocks of ordinals, of which a task holds one for at most two tiles of
sources, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import lower_ascii, row_of, slices, staged, text_buffers, word_spans

LEAST, SMOOTH, UNIT = 30, 5, 1_000_000_000
#: Terms of one transducer; bytes of transducers that go to the tasks at once (more take further scans of the languages concerned).
BLOCK, ROUND_BYTES = 50_000, 8 << 20
#: Text that a worker takes at once; counts that it keeps before it passes them on.
SLICE, HELD = 1 << 21, 500_000
#: Sources of a tile; numbers of a task's table of a block.
TILE, CELLS = 256, 1 << 18
_CHAR = np.zeros(256, bool)
_CHAR[[*range(97, 123), *range(128, 256)]] = True


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased, their bytes, their offsets, the row of each)."""
    raw, ends = text_buffers(column)
    raw = lower_ascii(raw)
    inside = _CHAR[raw]
    start, end, rows = word_spans(inside, ends)
    data, offsets = raw[inside], np.append(0, np.cumsum(end - start))
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), data, offsets, row_of(rows)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a slice that hold a term: lang, term, n."""
    for part in slices(batches, limit=SLICE, rows=1 << 16):
        terms, _, _, row = terms_of(part.column("text"))
        if not len(terms):
            continue
        terms, langs = terms.cast(pa.large_string()).dictionary_encode(), part.column("lang").dictionary_encode()
        many = len(terms.dictionary)
        once = np.unique(row * many + terms.indices.to_numpy(zero_copy_only=False))
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[once // many]
        key, n = np.unique(lang * many + once % many, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // many)).cast(pa.string()), terms.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n"])


class Transducer:
    """A minimal acyclic automaton of sorted terms; numbers on its edges add up to a term's place among them.

    Edges are kept as an open-addressing table over (state, byte)."""

    def __init__(self, source: np.ndarray, byte: np.ndarray, target: np.ndarray, add: np.ndarray, final: np.ndarray):
        self.edges = source, byte, target, add
        self.final = final
        key = source.astype(np.int64) << 8 | byte
        self.size = 1 << (2 * len(key) + 2).bit_length()
        self.keys = np.full(self.size, -1, np.int64)
        self.target, self.add = np.zeros(self.size, np.int32), np.zeros(self.size, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[todo[free]]
            own = self.keys[slot] == key[todo]
            self.target[slot[own]], self.add[slot[own]] = target[todo[own]], add[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) & (self.size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * -7046029254386353131) >> 33) & (self.size - 1)

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From sorted distinct terms: a state is complete once no later term passes through it, and then either equals a known one or is new.
        State 0 is the start."""
        known: dict[tuple, int] = {}
        counts, rows = [0], [()]  # of each state: terms below it, its edges (byte, target)
        finals = [False]
        path: list[list] = [[False, []]]  # open states of the last term: final, edges
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(rows)
                    rows.append(key[1])
                    finals.append(final)
                    counts.append(final + sum(counts[t] for _, t in edges))
                path[-1][1].append((last[len(path) - 1], state))

        for term in terms:
            same = 0
            while same < len(last) and same < len(term) and last[same] == term[same]:
                same += 1
            close(same)
            path.extend([False, []] for _ in term[same:])
            path[-1][0] = True
            last = term
        close(0)
        finals[0], rows[0] = path[0][0], tuple(path[0][1])
        edges = []
        for state, own in enumerate(rows):
            passed = int(finals[state])
            for byte, target in own:
                edges.append((state, byte, target, passed))
                passed += counts[target]
        table = np.array(edges, np.int64).reshape(-1, 4).astype(np.int32)
        return cls(*table.T, np.array(finals, bool))

    def dump(self) -> bytes:
        columns = [pa.array(x, pa.int32()) for x in self.edges]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([(c, pa.int32()) for c in "sbta"] + [("f", pa.binary())]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            final = pa.array([np.packbits(self.final).tobytes()] + [None] * max(0, len(columns[0]) - 1), pa.binary())
            out.write_batch(pa.RecordBatch.from_arrays([*columns, final], list("sbtaf")))
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        edges = [table.column(c).to_numpy() for c in "sbta"]
        return cls(*edges, np.unpackbits(np.frombuffer(table.column("f")[0].as_py(), np.uint8)).astype(bool))

    def places(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Place of each word data[offsets[i]:offsets[i + 1]] among the terms, -1 if it is none."""
        out = np.full(len(offsets) - 1, -1, np.int64)
        at, end, word = offsets[:-1].copy(), offsets[1:], np.arange(len(out))
        state, place = np.zeros(len(out), np.int64), np.zeros(len(out), np.int64)
        while len(word):
            over = at == end[word]
            if over.any():
                good = over & self.final[state]
                out[word[good]] = place[good]
                word, at, state, place = word[~over], at[~over], state[~over], place[~over]
            key = state << 8 | data[at]
            slot = self._slot(key)
            found = self.keys[slot]
            while True:
                on = np.flatnonzero((found != key) & (found >= 0))
                if not len(on):
                    break
                slot[on] = (slot[on] + 1) & (self.size - 1)
                found[on] = self.keys[slot[on]]
            hit = found == key
            word, at, slot = word[hit], at[hit] + 1, slot[hit]
            state, place = self.target[slot].astype(np.int64), place[hit] + self.add[slot]
        return out

    def terms(self) -> list[bytes]:
        """All terms, in order."""
        edges: dict[int, list] = {}
        for s, b, t in zip(*(x.tolist() for x in self.edges[:3])):
            edges.setdefault(s, []).append((b, t))
        out, stack = [], [(0, b"")]
        while stack:
            state, spelt = stack.pop()
            if self.final[state]:
                out.append(spelt)
            stack.extend((t, spelt + bytes([b])) for b, t in reversed(edges.get(state, ())))
        return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers of a partition's terms, sorted by lang and ordinal, a range of BLOCK ordinals each: lang, first ordinal, first term, terms, data."""

    def made(lang: str, block: int, terms: list[bytes]) -> pa.RecordBatch:
        row = [pa.array([lang]), pa.array([block * BLOCK], pa.int64()), pa.array([terms[0].decode()]), pa.array([len(terms)], pa.int64()), pa.array([Transducer.build(terms).dump()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["lang", "first", "first_term", "terms", "data"])

    own, held = None, []
    for batch in batches:
        for *key, term in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), batch.column("term").cast(pa.binary()).to_pylist()):
            if held and key != own:
                yield made(*own, held)
                held = []
            own = key
            held.append(term)
    if held:
        yield made(*own, held)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of transducers with their ordinals."""
    for batch in batches:
        for lang, first, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "data"))):
            terms = Transducer.load(data).terms()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(np.arange(len(terms)) + first), pa.array([t.decode() for t in terms], pa.string())], ["lang", "ordinal", "item"])


class Ranges:
    """A language's transducers in the order of their terms; a word is looked for where its first eight bytes can be."""

    def __init__(self, rows: list[tuple[int, bytes, Transducer]]):
        self.rows = sorted(rows, key=lambda x: x[0])
        self.starts = np.array([int.from_bytes(t[:8].ljust(8, b"\0"), "big") for _, t, _ in self.rows], np.uint64)

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ordinal of each word, -1 if it is no kept term."""
        size = np.diff(offsets)
        out = np.full(len(size), -1, np.int64)
        key = np.zeros(len(size), np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | np.where(size > k, data[np.minimum(offsets[:-1] + k, len(data) - 1)], 0).astype(np.uint64)
        low, high = np.searchsorted(self.starts, key, "left") - 1, np.searchsorted(self.starts, key, "right") - 1
        for r, (first, _, transducer) in enumerate(self.rows):
            at = np.flatnonzero((low <= r) & (r <= high) & (out < 0))
            if len(at):
                cut = np.append(0, np.cumsum(size[at]))
                place = transducer.places(data[np.repeat(offsets[at] - cut[:-1], size[at]) + np.arange(cut[-1])], cut)
                out[at] = np.where(place >= 0, place + first, -1)
        return out


@lru_cache(maxsize=1)
def _loaded(told) -> dict[str, Ranges]:
    out: dict[str, list] = {}
    for lang, first, first_term, data in told.value:
        out.setdefault(lang, []).append((first, first_term.encode(), Transducer.load(data)))
    return {lang: Ranges(rows) for lang, rows in out.items()}


def _recount(told):
    """Texts through the transducers: lang, source, ordinal, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _loaded(told)
        groups: dict[tuple, int] = {}
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            names = list(groups)
            lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
            group = pa.array(keys >> 40)
            return pa.RecordBatch.from_arrays([lang.take(group), source.take(group), pa.array(keys & ((1 << 40) - 1)), pa.array(sums)], ["lang", "source", "ordinal", "n"])

        for part in slices(batches, limit=SLICE, rows=1 << 16):
            langs, sources = part.column("lang").to_pylist(), part.column("source").to_pylist()
            group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources)], np.int64)
            _, data, offsets, row = terms_of(part.column("text"))
            if not len(row):
                continue
            words, found = group[row], np.full(len(row), -1, np.int64)
            codes = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
            code = np.array([codes[x] for x in langs])[row]
            for lang, i in codes.items():
                at = np.flatnonzero(code == i)
                if len(at) and lang in ranges:
                    size = offsets[at + 1] - offsets[at]
                    cut = np.append(0, np.cumsum(size))
                    found[at] = ranges[lang].ordinals(data[np.repeat(offsets[at] - cut[:-1], size) + np.arange(cut[-1])], cut)
            kept = found >= 0
            new, n = np.unique(words[kept] << 40 | found[kept], return_counts=True)
            keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([sums, n]), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield out()
                groups, keys, sums = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield out()

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block of ordinals: the sources of two tiles with what a term that they lack has, and the cells that they have. Sums of
    differences of each pair of sources: lang, x, y, value."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, width = batch.column("lang")[k].as_py(), batch.column("wide")[k].as_py()
            sides = [batch.column(c)[k].values for c in ("a", "b")]
            number, none = ([x.field(c).to_numpy() for x in sides] for c in ("number", "p0"))
            tables = [np.repeat(p0[:, None], width, axis=1) for p0 in none]
            cells = batch.column("cells")[k]
            if cells.is_valid:
                of, place, p = (cells.values.field(c).to_numpy() for c in ("number", "place", "p"))
                for own, table in zip(number, tables):
                    i = np.minimum(np.searchsorted(own, of), len(own) - 1)
                    mine = own[i] == of
                    table[i[mine], place[mine]] = p[mine]
            for i, x in enumerate(number[0].tolist()):
                later = number[1] > x
                if later.any():
                    value = np.abs(tables[1][later] - tables[0][i]).sum(axis=1)
                    many = len(value)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * many, pa.string()), pa.array(np.full(many, x), pa.int32()), pa.array(number[1][later], pa.int32()), pa.array(value, pa.int64())], ["lang", "x", "y", "value"])


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Terms in at least `least` documents of their lang, with their ordinals: lang, ordinal, term. docs: lang, source, text, none null."""
    df = docs.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    ordered = df.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    ordered = staged(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "terms")
    runs = ordered.groupBy("lang", "part").agg(F.min("at").alias("begin"), F.count("*").alias("terms"))
    before = F.coalesce(F.sum("terms").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.join(runs.withColumn("before", before), ["lang", "part"]).select("lang", (F.col("before") + F.col("at") - F.col("begin")).alias("ordinal"), "term")


def transducers(terms: DataFrame) -> DataFrame:
    """lang, first (ordinal), first_term, terms (their number), data: a stored table of the transducers of kept terms."""
    blocks = terms.withColumn("block", F.floor(F.col("ordinal") / BLOCK)).repartition("lang", "block").sortWithinPartitions("lang", "ordinal")
    return staged(blocks.select("lang", "block", "term").mapInArrow(_build, "lang string, first long, first_term string, terms long, data binary"), "transducers")


def recount(docs: DataFrame, machines: DataFrame) -> DataFrame:
    """Occurrences of kept terms: lang, source, ordinal, n. Transducers go to the tasks in rounds of ROUND_BYTES, each of which reads the
    documents of its languages; one transducer has a bounded number of terms."""
    spark, rounds = docs.sparkSession, []
    for row in machines.select("lang", "first", F.octet_length("data").alias("size")).orderBy("lang", "first").toLocalIterator():
        if not rounds or rounds[-1][1] + row["size"] > ROUND_BYTES:
            rounds.append(([], 0))
        rounds[-1] = (rounds[-1][0] + [(row["lang"], row["first"])], rounds[-1][1] + row["size"])
    out = None
    for own, _ in rounds:
        spans: dict[str, list[int]] = {}
        for lang, first in own:
            spans.setdefault(lang, []).append(first)
        pick = F.lit(False)
        for lang, firsts in spans.items():  # ranges of a language come in order
            pick |= (F.col("lang") == lang) & F.col("first").between(min(firsts), max(firsts))
        told = spark.sparkContext.broadcast([tuple(r) for r in machines.filter(pick).select("lang", "first", "first_term", "data").toLocalIterator()])
        rows = docs.filter(F.col("lang").isin(list(spans))).mapInArrow(_recount(told), "lang string, source string, ordinal long, n long")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def with_share(rows: DataFrame, name: str, count: str | F.Column, total: str, terms: str) -> DataFrame:
    """rows with the probability of a count in parts of UNIT: 1 + floor(UNIT (count + SMOOTH) / (total + SMOOTH terms)), exact; null without terms."""
    number = F.col(count) if isinstance(count, str) else count
    dividend = (number + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    divisor = F.nullif(F.col(total).cast("decimal(20,0)") + F.col(terms).cast("decimal(18,0)") * F.lit(SMOOTH), F.lit(0).cast("decimal(20,0)"))
    return rows.withColumns({"_dividend": dividend, "_divisor": divisor}).withColumn(name, F.lit(1).cast("long") + F.expr("_dividend div _divisor")).drop("_dividend", "_divisor")


def audit(docs: DataFrame, least: int = LEAST, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    Terms are `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; a language keeps those in at least `least` of its
    documents. A group (lang, source) gives each kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N its occurrences of kept terms, V their
    number; q is the same for the whole language. Part `pair`: item is another source of the language, value the sum of |p - its p| over
    all kept terms; all ranks. Part `term`: item is a kept term of the group with p > q, value p - q, the first `top` ranks. Ranks go by value
    descending, then item by its UTF-8 bytes.

    Null lang, source and text are ''. A group without terms has its pairs; a language without kept terms has pairs of value 0; repeated rows count each;
    an empty table gives no rows; other columns are not looked at."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    machines = transducers(kept_terms(docs, least))
    counts = staged(recount(docs, machines), "term-counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = machines.groupBy("lang").agg(F.sum("terms").alias("terms"))
    by_lang, all_of = Window.partitionBy("lang").orderBy("source"), Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "terms"])
    groups = groups.withColumns({"number": F.row_number().over(by_lang) - 1, "sources": F.count("*").over(all_of)})
    width = F.greatest(F.lit(1), F.expr(f"{CELLS} div least(sources, {2 * TILE})"))
    groups = groups.withColumns({"tile": F.expr(f"number div {TILE}").cast("int"), "tiles": F.expr(f"(sources + {TILE - 1}) div {TILE}").cast("int"), "width": width})
    groups = staged(with_share(groups, "p0", F.lit(0), "total", "terms"), "source-groups")

    cells = with_share(counts.join(groups, ["lang", "source"]), "p", "n", "total", "terms")
    # pairs: blocks of ordinals by two tiles of sources
    order = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    dealt = cells.select("lang", "number", "p", F.expr("cast(ordinal div width as int)").alias("block"), (F.col("ordinal") % F.col("width")).cast("int").alias("place"), "tile", order)
    keys = ["lang", "x_tile", "y_tile", "block"]
    dealt = dealt.withColumns({"x_tile": F.least("tile", "other"), "y_tile": F.greatest("tile", "other")}).groupBy(*keys).agg(F.collect_list(F.struct("number", "place", "p")).alias("cells"))
    tiles = groups.groupBy("lang", "tile").agg(F.sort_array(F.collect_list(F.struct("number", F.coalesce("p0", F.lit(0)).alias("p0")))).alias("own"), F.first("terms").alias("terms"), F.first("width").alias("width"))
    both = tiles.select("lang", F.col("tile").alias("x_tile"), F.col("own").alias("a"), "terms", "width").join(tiles.select("lang", F.col("tile").alias("y_tile"), F.col("own").alias("b")), "lang").filter("x_tile <= y_tile")
    last = F.greatest(F.lit(0), F.expr("(terms + width - 1) div width") - 1).cast("int")
    blocks = both.withColumn("block", F.explode(F.sequence(F.lit(0), last))).withColumn("wide", F.greatest(F.lit(0), F.least(F.col("width"), F.col("terms") - F.col("block") * F.col("width"))).cast("int"))
    sums = blocks.join(dealt, keys, "left").select("lang", "wide", "a", "b", "cells").mapInArrow(_compare, "lang string, x int, y int, value long").groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(F.struct(F.col("x").alias("number"), F.col("y").alias("of")), F.struct(F.col("y").alias("number"), F.col("x").alias("of"))))
    names = groups.select("lang", "number", "source")
    pairs = sums.select("lang", "value", ways).join(names, ["lang", "number"]).join(names.select("lang", F.col("number").alias("of"), F.col("source").alias("item")), ["lang", "of"])
    ranked = lambda *order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), *order))
    pairs = pairs.withColumn("rank", ranked(F.asc("of"))).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    whole = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("n"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("terms").alias("terms"))
    q = with_share(whole.join(of_lang, "lang"), "q", "n", "total", "terms").select("lang", "ordinal", "q")
    above = cells.select("lang", "source", "ordinal", "p").join(q, ["lang", "ordinal"]).filter("p > q").select("lang", "source", "ordinal", (F.col("p") - F.col("q")).alias("value"))
    first = above.withColumn("rank", ranked(F.asc("ordinal"))).filter(F.col("rank") <= top)
    spelt = machines.select("lang", "first", "data").mapInArrow(_expand, "lang string, ordinal long, item string")
    terms = first.join(spelt, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
