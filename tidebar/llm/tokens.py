"""Byte-level BPE ids of whole Arrow columns.

The ids are those of `tokenizers`. Its pre-tokeniser splits a text into short pieces that are encoded on their own, and
the same pieces come again and again. So the pieces are found on all texts of a batch at once, from the classes of
their bytes, and only pieces not met before are encoded, by the same vocabulary as ranks, which is several times faster for a
single piece and gives the same ids. A piece is looked up by its hash and compared byte by byte with the one that was encoded. Texts go through the tokenizer whole if they have characters from U+0240 on (their classes depend on the
Unicode version that it was built with), spell one of its special tokens, or hold a piece whose hash is another's.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tidebar.llm.common import prefix_hash, span_hash, text_buffers

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; beyond it starts anew.
CACHE_PIECES = 500_000
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_LIMIT = 0x240


@lru_cache(maxsize=2)
def tokenizer(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))


def byte_pairs(path: str | None = None):
    """The same vocabulary for single pieces, as ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """A worker's encoder: its tasks share the pieces that it knows."""
    return Encoder(path)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(_LIMIT, _OTHER, np.uint8)
    for i in range(_LIMIT):
        c = unicodedata.category(chr(i))[0]
        kinds[i] = _LETTER if c == "L" else _NUMBER if c == "N" else _OTHER
    kinds[[*range(9, 14), 32, 0x85, 0xA0]] = _SPACE
    return kinds


def pieces(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokeniser's pieces; raw holds only characters under U+0240, ends cut it into texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    lead = raw < 0xC0
    code = raw.astype(np.int16)
    wide = np.flatnonzero(~lead)
    code[wide] = ((code[wide] & 0x1F) << 6) | (code[wide + 1] & 0x3F)
    code[wide + 1] = code[wide]
    kind = _classes()[code]
    text_start = np.zeros(n + 1, bool)
    text_start[ends] = True
    change = text_start[:n].copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    stop = np.append(run[1:], n)
    k = kind[run]
    # words take the blank before them along
    space_before = np.zeros(len(run), bool)
    space_before[1:] = (raw[run[1:] - 1] == 32) & ~text_start[run[1:]]
    word = k != _SPACE
    starts = [run[word] - space_before[word]]
    # a run of white space before a word leaves its last character to itself, or to the word if it is a blank
    a, b = run[~word], stop[~word]
    final = text_start[b]
    last = np.where(raw[b - 1] < 0x80, b - 1, b - 2)
    starts.append(a[final])
    a, last = a[~final], last[~final]
    starts.append(a[last > a])
    starts.append(last[raw[last] != 32])
    out = np.zeros(n, bool)
    for s in starts:
        out[s] = True
    # 's 't 're 've 'm 'll 'd after a word
    quote = np.flatnonzero((raw[run] == 39) & (stop - run == 1) & ~space_before)
    quote = quote[(quote + 1 < len(run))]
    quote = quote[(k[quote + 1] == _LETTER) & ~text_start[run[quote + 1]]]
    if len(quote):
        at, size = run[quote], stop[quote + 1] - run[quote + 1]
        first, second = raw[at + 1], raw[np.minimum(at + 2, n - 1)]
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        two = (size >= 2) & (((second == 101) & ((first == 114) | (first == 118))) | ((second == 108) & (first == 108)))
        length = np.where(one, 1, np.where(two, 2, 0))
        at, size, length = at[length > 0], size[length > 0], length[length > 0]
        out[at + 1] = False
        rest = at[size > length] + 1 + length[size > length]
        out[rest] = True
    return np.flatnonzero(out)


class Encoder:
    """Ids of texts; keeps the ids and bytes of pieces it has met, in an open-addressing table over their hashes."""

    def __init__(self, path: str | None = None, ranks: str | None = None):
        self.tokenizer = tokenizer(path)
        self.bpe = byte_pairs(ranks) if ranks or not path else None
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.slots = np.full(1 << (3 * CACHE_PIECES).bit_length(), -1, np.int32)
        self.keys = np.zeros(0, np.uint64)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.at, self.bytes = np.zeros(1, np.int64), np.zeros(0, np.uint8)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the ids of a piece are; -1 if it is new."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo) and len(self.keys):
            at = self.slots[slot]
            there = at >= 0
            same = there & (self.keys[at] == keys[todo])
            out[todo[same]] = at[same]
            on = there & ~same
            todo, slot = todo[on], (slot[on] + 1) & (len(self.slots) - 1)
        return out

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        texts = [x.decode() for x in pieces]
        if self.bpe:
            got = [self.bpe.encode_ordinary(x) for x in texts]
        else:
            got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        number = np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32)
        self.keys = np.append(self.keys, keys)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), np.uint32))
        self.first = np.append(self.first, self.first[-1] + np.cumsum(list(map(len, got))))
        self.bytes = np.append(self.bytes, np.frombuffer(b"".join(pieces), np.uint8))
        self.at = np.append(self.at, self.at[-1] + np.cumsum(list(map(len, pieces))))
        slot = self._slot(keys)
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]
            out = self.slots[slot] != number
            number, slot = number[out], (slot[out] + 1) & (len(self.slots) - 1)

    def _whole(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Texts that the tokenizer has to see in one piece."""
        far = np.append(0, np.cumsum(raw > 0xC8))
        odd = far[ends[1:]] > far[ends[:-1]]
        data = raw.tobytes()
        for token in self.special:
            at = data.find(token)
            while at >= 0:
                odd[np.searchsorted(ends, at, "right") - 1] = True
                at = data.find(token, at + 1)
        return odd

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts among them); a null has none."""
        raw, ends = text_buffers(column)
        odd = self._whole(raw, ends)
        plain = ends
        if odd.any():
            raw = raw[~np.repeat(odd, np.diff(ends))]
            plain = np.append(0, np.cumsum(np.where(odd, 0, np.diff(ends))))
        start = pieces(raw, plain)
        end = np.append(start[1:], len(raw))
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        place = self._known(raw, start, end)
        first, last = self.first[place], self.first[place + 1]
        ids = _gather(self.ids, first, last - first)
        cuts = np.append(0, np.cumsum(last - first))[np.searchsorted(start, plain)]
        # pieces tile the bytes, so those of the pieces found have to be the same again
        at = self.at[place]
        size = self.at[place + 1] - at
        if not np.array_equal(size, end - start) or not np.array_equal(_gather(self.bytes, at, size), raw):
            other = np.array([i for i in range(len(start)) if self.bytes[self.at[place[i]] : self.at[place[i] + 1]].tobytes() != raw[start[i] : end[i]].tobytes()])
            odd[np.searchsorted(plain, start[other], "right") - 1] = True
        if not odd.any():
            return ids, cuts
        whole = iter(self.tokenizer.encode_batch_fast(column.filter(pa.array(odd)).to_pylist(), add_special_tokens=False))
        parts = [np.array(next(whole).ids, np.uint32) if odd[i] else ids[cuts[i] : cuts[i + 1]] for i in range(len(odd))]
        return np.concatenate(parts), np.append(0, np.cumsum(list(map(len, parts))))

    def _known(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each piece, new ones encoded."""
        if not len(start):
            return np.zeros(0, np.int64)
        keys = span_hash(prefix_hash(raw.astype(np.uint64) + np.uint64(1)), start, end)
        place = self._places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            data = raw.tobytes()
            self._learn(fresh, [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            place[new] = self._places(keys[new])
        return place


def _gather(values: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of values[b:b + s]."""
    stop = np.cumsum(sizes)
    if not len(stop) or not stop[-1]:
        return values[:0]
    return values[np.repeat(begin - (stop - sizes), sizes) + np.arange(stop[-1])]
