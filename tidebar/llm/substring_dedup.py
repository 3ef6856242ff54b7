"""Substring deduplication by recompression.

A text is a sequence of words. Rounds of recompression shorten it: in each round a boundary between two neighbouring
symbols X, Y goes if X = Y (a run) or if X falls into the round's left half and Y into its right half of the alphabet
(a pair), and what is then joined gets a new name. A name is the hash of its parts, so it is the same in all documents
without a dictionary that grows with the corpus, and equal substrings get equal symbols except near their ends. With
each boundary goes the span of words that decides it, so a symbol speaks for a window only if the window holds all
that made it.

Round 1 (reveal): the symbols of the last round are counted over the corpus; a window that holds a symbol found once
cannot occur twice. Equal names of different symbols only let a window through to the next round. Round 2 (verify): the windows left
are compared by two independent 64-bit hashes of all their words, 128 bits together. Both rounds deal their hashes to buckets, whose number
grows with the text. Before the shuffle each task settles repeats within its own slice and sends one row for them, so
a passage found in a third of all documents is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import mix, powers, prefix_hash, ragged, row_of, signed, slices, span_hash, text_bytes, words_of

WINDOW = 35
LEVELS = 5
#: Bytes of text for each bucket of hashes; a bucket is what one task holds at once.
LEAST_BUCKETS, BUCKET_BYTES = 128, 64 << 20
_FAR = np.int64(1) << np.int64(60)
#: Hashes that a task holds before it sends them.
SEND_ROWS = 1 << 18
DEALT = ["hashes", "checks", "ids", "ats", "settled", "ride_ids", "ride_ats", "ride_sizes"]
_DEALT = "bucket int, buckets int, hashes array<long>, checks array<long>, ids array<long>, ats array<int>, settled array<boolean>, ride_ids array<long>, ride_ats array<int>, ride_sizes array<int>"
_LIST = {c: pa.list_(pa.bool_() if c == "settled" else pa.int64() if c in ("hashes", "checks", "ids", "ride_ids") else pa.int32()) for c in DEALT}
_EMPTY = pa.schema([("bucket", pa.int32()), ("buckets", pa.int32()), *_LIST.items()])
_HOME = "home long, ids array<long>, ats array<int>, ride_ids array<long>, ride_ats array<int>, ride_sizes array<int>"


def recompress(words: np.ndarray, edges: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, lo, hi) of each symbol after `levels` rounds: words[lo:hi] decide that the symbol is there.

    edges: True at the first word of each document; nothing is joined across, and a symbol at a document's end speaks
    for no window (lo or hi lies far outside)."""
    name, edge = words, edges
    # at first words are known by themselves; from the second round on, a document's edge is not
    lo = np.arange(len(words), dtype=np.int64)
    hi = lo.copy()
    end_hi = np.int64(len(words))
    for level in range(levels):
        n = len(name)
        if not n:
            break
        left = (mix(name ^ np.uint64(0x5851F42D4C957F2D * (level + 1) % (1 << 64))) & np.uint64(1)).astype(bool)
        joined = np.zeros(n, bool)
        joined[1:] = (name[1:] == name[:-1]) | (left[:-1] & ~left[1:])
        keep = ~joined | edge
        first = np.flatnonzero(keep)
        after = np.append(first[1:], n)
        place = np.arange(n) - np.repeat(first, after - first)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(name + np.uint64(level + 1)) * powers(n)[place], out=total[1:])
        merged = mix(total[after] - total[first])
        # a boundary is decided by the whole of the symbols at its sides
        new_lo, new_hi = np.empty_like(lo), np.empty_like(hi)
        new_lo[0], new_lo[1:] = -_FAR, lo[:-1]
        new_hi[:-1], new_hi[-1] = hi[1:], end_hi
        new_lo[edge], new_hi[edge] = -_FAR, _FAR
        end_hi = _FAR
        name = np.where(after - first > 1, merged, name[first])
        lo, hi, edge = new_lo[first], new_hi[first], edge[first]
    return name, lo, np.append(hi[1:], end_hi)[: len(name)]


def _document_edges(rows: np.ndarray) -> np.ndarray:
    edges = np.zeros(rows[-1], bool)
    edges[rows[:-1][rows[1:] > rows[:-1]]] = True
    return edges


def _sorted(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings equal sequences together, True where another one begins); without checks the hashes alone decide."""
    if not len(checks):
        order = np.argsort(hashes, kind="stable")
        return order, np.append(True, hashes[order][1:] != hashes[order][:-1])
    order = np.lexsort((checks, hashes))
    h, c = hashes[order], checks[order]
    return order, np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))


def _deal(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, ats: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket. Of equal sequences one goes to its bucket, marked as settled; the places of the others go along as
    ranges, since neighbours repeat together. checks: a second hash of each, or none."""
    if not len(hashes):
        return
    order, new = _sorted(hashes, checks)
    again = (np.append(~new[1:], False) | ~new)[new]
    lead, rest = order[new], np.sort(order[~new])
    bucket = (mix(hashes[lead] ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(buckets)).astype(np.int64)
    by = np.lexsort((lead, bucket))
    lead, bucket, again = lead[by], bucket[by], again[by]
    opens = np.flatnonzero(np.append(True, (ids[rest][1:] != ids[rest][:-1]) | (ats[rest][1:] != ats[rest][:-1] + 1))) if len(rest) else rest
    length = np.diff(np.append(opens, len(rest)))
    first = rest[opens]
    # a range needs no comparison and rides with any bucket: deal them evenly by document
    ride = (mix(ids[first].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(ride, kind="stable")
    first, length, ride = first[by], length[by], ride[by]
    used = np.union1d(bucket, ride)
    own, along = np.append(np.searchsorted(bucket, used), len(bucket)), np.append(np.searchsorted(ride, used), len(ride))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(used, pa.int32()),
            pa.array(np.full(len(used), buckets), pa.int32()),
            ragged(signed(hashes[lead]), own, pa.int64()),
            ragged(signed(checks[lead]), own, pa.int64()) if len(checks) else ragged(np.zeros(0, np.int64), np.zeros(len(own), int), pa.int64()),
            ragged(ids[lead], own, pa.int64()),
            ragged(ats[lead], own, pa.int32()),
            ragged(again, own, pa.bool_()),
            ragged(ids[first], along, pa.int64()),
            ragged(ats[first], along, pa.int32()),
            ragged(length, along, pa.int32()),
        ],
        ["bucket", "buckets", *DEALT],
    )


def _repeated(bucket: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the places whose sequence occurs elsewhere too, by document, as places and ranges."""
    hashes, checks, ids, ats, settled, ride_ids, ride_ats, ride_sizes = (np.concatenate(bucket[c].to_numpy()) for c in DEALT)
    order, new = _sorted(hashes, checks)
    same = ~new[: len(order)]
    same[:-1] |= same[1:]
    found = settled.astype(bool)
    found[order] |= same
    return _sent_home(ids[found], ats[found], ride_ids, ride_ats, ride_sizes, int(bucket["buckets"].iloc[0]))


def _sent_home(ids: np.ndarray, ats: np.ndarray, ride_ids: np.ndarray, ride_ats: np.ndarray, ride_sizes: np.ndarray, buckets: int) -> pd.DataFrame:
    """Places and ranges by the bucket of their document."""
    home, ride_home = home_of(ids, buckets), home_of(ride_ids, buckets)
    used = np.union1d(home, ride_home)

    def lists(key: np.ndarray, *values: np.ndarray) -> list[list[np.ndarray]]:
        order = np.argsort(key, kind="stable")
        cuts = np.searchsorted(key[order], used[1:])
        return [np.split(v[order], cuts) if len(used) else [] for v in values]

    columns = [*lists(home, ids, ats), *lists(ride_home, ride_ids, ride_ats, ride_sizes)]
    names = ["ids", "ats", "ride_ids", "ride_ats", "ride_sizes"]
    return pd.DataFrame({"home": used} | {n: pd.Series(c, dtype=object) for n, c in zip(names, columns, strict=True)})


def home_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document's id, as the session's rows have it."""
    return np.mod(ids, buckets).astype(np.int64)


class _Sender:
    """Gathers a task's hashes, to settle repeats within the task before the shuffle."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, ats: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((hashes, checks, ids, ats.astype(np.int32)))
        self.n += len(hashes)
        if self.n >= SEND_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from _deal(*map(np.concatenate, zip(*self.held, strict=True)), self.buckets)
        self.held, self.n = [], 0


def _usable(words: np.ndarray, rows: np.ndarray, levels: int, window: int):
    """Symbols that can speak for a window: (name, lo, hi, row, ordinal in the row)."""
    name, lo, hi = recompress(words, _document_edges(rows), levels)
    use = (lo >= 0) & (hi < _FAR) & (hi - lo <= window)
    name, lo, hi = name[use], lo[use], hi[use]
    row = np.searchsorted(rows, lo, "right") - 1
    return name, lo, hi, row, np.arange(len(row)) - np.searchsorted(row, row)


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("__id").to_numpy(zero_copy_only=False)


def _symbols(levels: int, window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets)
        for part in slices(batches):
            words, rows, _ = words_of(part.column("text"))
            if len(words):
                name, _, _, row, ordinal = _usable(words, rows, levels, window)
                yield from sender.add(name, name[:0], _ids(part)[row], ordinal)
        yield from sender.flush()

    return run


def _flat(table: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in table.column(column).chunks)]).astype(np.int64)


class _Marks:
    """The places that came back for the documents of a home."""

    def __init__(self, documents: pa.Table, back: pa.Table):
        self.known = np.unique(documents.column("__id").to_numpy())
        ids, ats, ride_ids, ride_ats, sizes = (_flat(back, c) for c in ("ids", "ats", "ride_ids", "ride_ats", "ride_sizes"))
        stop = np.cumsum(sizes)
        inside = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - sizes, sizes)
        ids, ats = np.append(ids, np.repeat(ride_ids, sizes)), np.append(ats, np.repeat(ride_ats, sizes) + inside)
        owner = np.searchsorted(self.known, ids)
        order = np.argsort(owner, kind="stable")
        self.ats, self.cuts = ats[order], np.searchsorted(owner[order], np.arange(len(self.known) + 1))

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the marks of a slice; equal rows each get all of theirs."""
        at = np.searchsorted(self.known, _ids(part))
        many = self.cuts[at + 1] - self.cuts[at]
        row = np.repeat(np.arange(len(at)), many)
        return row, self.ats[np.repeat(self.cuts[at], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]


def _windows(levels: int, window: int, buckets: int):
    """Sends the windows that hold no symbol found once."""

    def run(documents: pa.Table, back: pa.Table) -> pa.Table:
        sender, marks, sent = _Sender(buckets), _Marks(documents, back), []
        for part in slices(documents.to_batches()):
            words, rows, _ = words_of(part.column("text"))
            n = len(words)
            if n < window:
                continue
            _, lo, hi, row, ordinal = _usable(words, rows, levels, window)
            mark_row, mark = marks.of(part)
            first = np.searchsorted(row, np.arange(len(rows) - 1))
            alone = np.ones(len(row), bool)
            alone[first[mark_row] + mark] = False
            # a lone symbol rules out the windows that begin in [hi - window, lo]
            delta = np.bincount(np.maximum(hi[alone] - window, 0), minlength=n + 1) - np.bincount(lo[alone] + 1, minlength=n + 1)[: n + 1]
            at = np.flatnonzero(np.cumsum(delta)[:n] == 0)
            doc = row_of(rows)[at]
            inside = at + window <= rows[doc + 1]
            at, doc = at[inside], doc[inside]
            hashes, checks = (span_hash(prefix_hash(x), at, at + window) for x in (words, mix(words)))
            sent += sender.add(hashes, checks, _ids(part)[doc], at - rows[doc])
        sent += sender.flush()
        return pa.Table.from_batches(sent, schema=sent[0].schema if sent else _EMPTY)

    return run


def _cut(window: int):
    def run(documents: pa.Table, back: pa.Table) -> pa.Table:
        marks, out = _Marks(documents, back), []
        for part in slices(documents.to_batches()):
            _, rows, (raw, start, end) = words_of(part.column("text"))
            n = len(start)
            mark_row, mark = marks.of(part)
            begin = np.unique(rows[mark_row] + mark)
            delta = np.bincount(begin, minlength=n + 1) - np.bincount(begin + window, minlength=n + 1)[: n + 1]
            keep = np.cumsum(delta)[:n] == 0
            kept_rows = np.append(0, np.cumsum(keep))[rows]
            texts = joined_words(raw, start[keep], end[keep], kept_rows)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        part.column("__row"),
                        part.column("text"),
                        pa.array(np.diff(rows), pa.int64()),
                        pa.array(np.diff(rows) - np.diff(kept_rows), pa.int64()),
                        pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    ["__row", "text", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )
            )
        return pa.Table.from_batches(out)

    return run


def joined_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """The words of each row, joined by one space."""
    size = end - start + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    source = np.repeat(start - (stop - size), size) + np.arange(total)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))] if total else np.zeros(0, np.uint8)
    out[stop - 1] = 32
    cuts = np.append(0, stop)[rows]
    data = out.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS, bucket_bytes: int = BUCKET_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Removes every word inside a `window`-word sequence that also starts anywhere else in the corpus, same document included.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. Returns all columns of docs and n_words,
    n_removed, kept_text (kept words joined by one space), kept_sha256; a column of docs with one of these names gives way.
    A null or empty text has no words and an empty kept_text. Repeated rows repeat each other's windows, so both lose them.
    keep: the columns of docs to return (all). An id may be null or repeat: rows are told apart by a 64-bit hash of id and text together; rows equal in
    both are dealt with in one task. No rows in, no rows out.
    """
    made = ["n_words", "n_removed", "kept_text", "kept_sha256"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rest = [F.col(f"`{c}`") for c in kept if c != text_col] or [F.lit(0).alias("__none")]
    keyed = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("__id"), F.struct(*rest).alias("__row"), F.col(text_col).alias("text"))
    buckets = max(LEAST_BUCKETS, -(-text_bytes(keyed) // bucket_bytes))
    # both returns take the same columns of the documents, so that their texts are dealt out once
    homes = keyed.withColumn("home", F.pmod("__id", F.lit(buckets)))
    symbols = keyed.select("__id", "text").mapInArrow(_symbols(levels, window, buckets), _DEALT)
    known = symbols.groupBy("bucket").applyInPandas(_repeated, _HOME)
    windows = homes.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(_windows(levels, window, buckets), _DEALT)
    found = windows.groupBy("bucket").applyInPandas(_repeated, _HOME)
    shape = f"__row {keyed.schema['__row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept_text string, kept_sha256 string"
    out = homes.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(_cut(window), shape)
    return out.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in kept], *made)
