"""Byte-level BPE by segment trees, and back: whole texts to token ids, ids to texts.

A text is cut into pieces as its vocabulary says; inside a piece the adjacent pair of lowest rank is merged, the leftmost if several have it,
until no pair can be merged. A piece's pairs are the leaves of a segment tree whose nodes hold the least (rank, place) below them:
the root names the next merge, and a merge sets three leaves (its own, the one before, the one that goes), each with one path to the
root. So a piece of n bytes takes n log n steps however long it is. Trees of equal height are merged side by side as rows of one
array; a piece beyond LONG bytes has a tree of its own, as do the few of a rare height.

Pieces recur, so a worker keeps the ids of those it has met (`tokens.Encoder`, which also finds the pieces of most texts on whole batches).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import ragged, slices
from tidebar.llm.tokens import CACHE_PIECES, VOCABULARY, Encoder, _gather

#: Beyond so many bytes a piece has a tree of its own; so have pieces of which fewer than FEW share a height.
LONG, FEW = 64, 12
#: Trees merged side by side, which a processor's cache holds.
ROWS = 8192
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        alphabet, ids = byte_alphabet(), data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.first = np.array([ids.get(c, -1) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], np.int64)
        if (self.first < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        #: (left << 32 | right) -> (rank, merged)
        self.merges = {ids[a] << 32 | ids[b]: (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))}
        # the same as an open-addressing table over the pairs' hashes
        keys = np.fromiter(self.merges, np.int64)
        self.keys = np.full(1 << (4 * len(keys)).bit_length(), -1, np.int64)
        self.ranks = np.full(len(self.keys), -1, np.int32)
        rank, slot, todo = np.array([self.merges[k][0] for k in keys.tolist()], np.int32), self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            own = self.keys[slot] == keys[todo]
            self.ranks[slot[own]] = rank[todo[own]]
            todo, slot = todo[~own], (slot[~own] + 1) & (len(self.keys) - 1)
        self.merged = np.zeros(len(pairs), np.int64)
        for rank, token in self.merges.values():
            self.merged[rank] = token
        tokens = {i: bytes(alphabet[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(tokens) + 1
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        self.at = np.append(0, np.cumsum([len(tokens.get(i, b"")) for i in range(size)]))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * -7046029254386353131) >> 40) & (len(self.keys) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it does not merge; an id below 0 is none."""
        key = (left << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], -1)
        todo = (found != key) & (found >= 0)
        if todo.any():
            at = np.nonzero(todo)
            key, slot = key[at], slot[at]
            while len(slot):
                slot = (slot + 1) & (len(self.keys) - 1)
                found = self.keys[slot]
                hit = found == key
                out[tuple(a[hit] for a in at)] = self.ranks[slot[hit]]
                on = ~hit & (found >= 0)
                at, key, slot = tuple(a[on] for a in at), key[on], slot[on]
        out[(left < 0) | (right < 0)] = -1
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, merges = len(piece), self.merges
        token = self.first[np.frombuffer(piece, np.uint8)].tolist()
        if n < 2:
            return token
        size = 1 << (n - 2).bit_length()
        none = (_NONE,)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            found = merges.get(token[i] << 32 | token[i + 1])
            if found:
                tree[size + i] = (found[0], i, found[1])
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: tuple) -> None:
            at = size + leaf
            tree[at] = value
            while at > 1:
                at >>= 1
                least = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == least:
                    return
                tree[at] = least

        def pair(i: int) -> tuple:
            found = merges.get(token[i] << 32 | token[after[i]]) if after[i] < n else None
            return (found[0], i, found[1]) if found else none

        while tree[1] is not none:
            _, i, token[i] = tree[1]
            gone = after[i]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            if gone < n - 1:
                put(gone, none)
            put(i, pair(i)) if i < n - 1 else None
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def merge_many(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Ids of pieces of 2 to leaves + 1 bytes, whose trees have `leaves` leaves, a power of two."""
        m, width = len(pieces), leaves + 1
        size = np.array(list(map(len, pieces)))
        token = np.full((m, width + 1), -1, np.int64)
        inside = np.arange(width)[None, :] < size[:, None]
        token[:, :width][inside] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (m, 1))
        before = np.tile(np.arange(-1, width), (m, 1))
        tree = np.full((m, 2 * leaves), _NONE, np.int64)
        rank = self.rank(token[:, :leaves], token[:, 1:width])
        tree[:, leaves:] = np.where(rank >= 0, rank << 8 | np.arange(leaves), _NONE)
        for i in range(leaves - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = leaf + leaves
            tree[row, at] = value
            while at[0] > 1:  # all leaves are equally deep
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])

        def refresh(row: np.ndarray, i: np.ndarray) -> None:
            ok = (i >= 0) & (i < leaves)
            row, i = row[ok], i[ok]
            if len(row):
                r = self.rank(token[row, i], token[row, np.minimum(after[row, i], width)])
                put(row, i, np.where(r >= 0, r << 8 | i, _NONE))

        row = np.flatnonzero(tree[:, 1] != _NONE)
        while len(row):
            root = tree[row, 1]
            i = root & 255
            token[row, i] = self.merged[root >> 8]
            gone = after[row, i]
            token[row, gone] = -1
            to = after[row, gone]
            after[row, i] = to
            before[row, np.minimum(to, width)] = i
            refresh(row, np.where(gone < leaves, gone, -1))
            refresh(row, i)
            refresh(row, before[row, i])
            row = row[tree[row, 1] != _NONE]
        alive = token[:, :width] >= 0
        ids, cuts = token[:, :width][alive].tolist(), np.append(0, np.cumsum(alive.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces, in their order."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.array(list(map(len, pieces)), np.int64)
        height = np.ceil(np.log2(np.maximum(size - 1, 1))).astype(int)
        for h in np.unique(height[size <= LONG + 1]).tolist():
            own = np.flatnonzero((height == h) & (size > 1) & (size <= LONG + 1))
            if len(own) >= FEW:
                for at in range(0, len(own), ROWS):
                    some = own[at : at + ROWS].tolist()
                    for i, ids in zip(some, self.merge_many([pieces[i] for i in some], 1 << h)):
                        out[i] = ids
        for i, piece in enumerate(pieces):
            if piece and not out[i]:
                out[i] = self.merge_one(piece)
        return out


class _WholeTexts:
    """Texts that `tokens.Encoder` cannot cut on bytes alone: cut at special tokens and by the library's own classes of characters, then
    merged by the trees."""

    def __init__(self, tokenizer, vocabulary: Vocabulary):
        self.cut, self.vocabulary, self.known, self.alphabet = tokenizer.pre_tokenizer, vocabulary, {}, byte_alphabet()
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def encode_batch_fast(self, texts: list[str], add_special_tokens: bool = False) -> list[SimpleNamespace]:
        rows = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            rows.append([x for k, part in enumerate(parts) for x in ([part] if k % 2 else [(p,) for p, _ in self.cut.pre_tokenize_str(part)] if part else [])])
        if len(self.known) > CACHE_PIECES:
            self.known = {}
        new = list({x[0] for row in rows for x in row if isinstance(x, tuple)} - self.known.keys())
        self.known.update(zip(new, self.vocabulary.merge([bytes(self.alphabet[c] for c in p) for p in new])))
        ids = lambda x: self.known[x[0]] if isinstance(x, tuple) else [self.vocabulary.special[x]]
        return [SimpleNamespace(ids=[i for x in row for i in ids(x)]) for row in rows]


class _Ready(dict):
    """Ids of the pieces that are about to be learnt."""

    encode_ordinary = dict.__getitem__


class TreeEncoder(Encoder):
    """Finds pieces and keeps their ids as `Encoder` does; new pieces are merged by segment trees."""

    def __init__(self, path: str | None = None):
        super().__init__(path)
        self.vocabulary = vocabulary(path)
        self.tokenizer, self.bpe = _WholeTexts(self.tokenizer, self.vocabulary), _Ready()

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        self.bpe = _Ready(zip([x.decode() for x in pieces], self.vocabulary.merge(pieces)))
        super()._learn(keys, pieces)


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=2)
def tree_encoder(path: str | None = None) -> TreeEncoder:
    """A worker's encoder: its tasks share the pieces that it knows."""
    return TreeEncoder(path)


def texts_of(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> pa.Array:
    """Texts of rows of ids: the bytes of their tokens, what is no UTF-8 among them replaced; ids without a token have no bytes."""
    ids = np.where((ids >= 0) & (ids < len(vocabulary.at) - 1), ids, -1)
    size = np.where(ids >= 0, vocabulary.at[ids + 1] - vocabulary.at[ids], 0)
    data = _gather(vocabulary.bytes, np.where(ids >= 0, vocabulary.at[ids], 0), size)
    ends = np.append(0, np.cumsum(size))[offsets]
    out = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def _encode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            ids, cuts = tree_encoder(path).encode(part.column("__text"))
            yield pa.RecordBatch.from_arrays([part.column("__row"), ragged(ids.astype(np.int32), cuts, pa.int32())], ["__row", "ids"])

    return run


def _decode(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("__ids")
                sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                text = texts_of(ids, np.append(0, np.cumsum(sizes)), vocabulary(path))
                yield pa.RecordBatch.from_arrays([part.column("__row"), text], ["__row", "decoded"])

    return run


def _rows(df: DataFrame, keep: list[str] | None, made: list[str]) -> tuple[list[str], F.Column]:
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    return kept, F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("__none"))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per document: its columns, ids (array of int) and n_tokens.

    ids are those of the tokenizers library without special tokens added, truncation or padding; the string of a special token in a text is
    that token. path: a byte-level BPE file of that library (on every executor), by default the public vocabulary of 50,257 ids. A
    null or empty text has no ids; repeated rows get a row each; keep: the columns to return (all); those named ids or n_tokens give way."""
    kept, row = _rows(docs, keep, ["ids", "n_tokens"])
    keyed = docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    out = keyed.mapInArrow(_encode(path), f"__row {keyed.schema['__row'].dataType.simpleString()}, ids array<int>")
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in kept], "ids", F.size("ids").cast("long").alias("n_tokens"))


def decode(tokens: DataFrame, ids_col: str = "ids", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """One row per row of tokens: its columns and decoded, the text of its ids, special tokens included.

    Null lists and lists without ids give an empty text; null ids and ids without a token add nothing; bytes that are no UTF-8 become
    U+FFFD. A column named decoded gives way."""
    kept, row = _rows(tokens, keep, ["decoded"])
    keyed = tokens.select(row.alias("__row"), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids"))
    out = keyed.mapInArrow(_decode(path), f"__row {keyed.schema['__row'].dataType.simpleString()}, decoded string")
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in kept], "decoded")


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """keep's columns with ids, n_tokens and the text decoded from those ids."""
    return decode(encode(docs, text_col, path, keep), path=path)
