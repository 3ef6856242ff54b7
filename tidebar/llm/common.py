"""Helpers of the corpus operators: text hashing on whole Arrow batches, staged tables, sizes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
#: Bytes and rows of text that a worker hashes at once; one longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1 << 19, 1024


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A session without one gets a temporary folder if it runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def give_back() -> None:
    """Returns a worker's free memory to the system: workers are kept between tasks, and stages with other needs follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        return


def staged(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder, in folders by a column if one is named, and reads it back: cuts the lineage and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column over all rows (one number on the driver)."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def bounded_sample(df: DataFrame, key: list[str], rows: int, seed: int = 0) -> DataFrame:
    """At most `rows` rows, those with the smallest hashes of their key; the same whatever the partitions.

    Hashes that are surely too large are dropped before the sort, so no task brings more than its share to it."""
    total = df.count()
    order = F.xxhash64(F.lit(seed), *key)
    if total > 4 * rows:
        df = df.filter(F.pmod(order, F.lit(1 << 31)) < int((1 << 31) * 2 * rows / total))
    return df.withColumn("__order", F.struct(F.pmod(order, F.lit(1 << 31)), order)).orderBy("__order", *key).limit(rows).drop("__order")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**i modulo 2**64 for i < n, or of its inverse."""
    key = "inverse" if inverse else "plain"
    if len(_POWERS.get(key, ())) < n:
        step = pow(BASE, -1, 1 << 64) if inverse else BASE
        table = np.full(max(n, SLICE_BYTES + (1 << 16)), step, np.uint64)
        table[0] = 1
        _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    return _POWERS[key][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans, from prefix_hash(values)."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start])


def window_hash(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` values."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    start = np.arange(len(values) - size + 1)
    return span_hash(prefix_hash(values), start, start + size)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds at most `limit` bytes of text and `rows` rows, or one row; at the end of the task
    free memory goes back to the system."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1), at + rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def word_spans(is_word: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes inside each row, and rows' offsets among the words."""
    n = len(is_word)
    first, last = is_word.copy(), is_word.copy()
    if n:
        first[1:] &= ~is_word[:-1]
        last[:-1] &= ~is_word[1:]
        begins = ends[:-1][ends[:-1] < n]
        first[begins] = is_word[begins]
        stops = ends[1:][ends[1:] > 0] - 1
        last[stops] = is_word[stops]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, ends)


def space_separated(raw: np.ndarray) -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+`."""
    return ~((raw == 32) | ((raw >= 9) & (raw <= 13)))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)


def letters_digits(lowered: np.ndarray) -> np.ndarray:
    """Bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text whose A-Z are lower-cased."""
    return ((lowered >= 48) & (lowered <= 57)) | ((lowered >= 97) & (lowered <= 122)) | (lowered >= 128)


def words_of(column: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(hash of each word, rows' offsets among the words, (bytes, starts, ends)).

    plain: lower-cased letters and digits; else words between white space, unchanged."""
    raw, ends = text_buffers(column)
    if plain:
        raw = lower_ascii(raw)
    start, end, rows = word_spans(letters_digits(raw) if plain else space_separated(raw), ends)
    prefix = prefix_hash(raw.astype(np.uint64) + np.uint64(1))
    return span_hash(prefix, start, end), rows, (raw, start, end)


def row_of(rows: np.ndarray) -> np.ndarray:
    """Row number of each word, from the rows' offsets."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


class Bitmap:
    """Bits of hashes: has() is true for every hash that was set and, the fuller it is, for others."""

    def __init__(self, size: int):
        """size: bits, a power of two."""
        self.words = np.zeros(size // 64, np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h), bool)
        spot = h & np.uint64(64 * len(self.words) - 1)
        return (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def bitmap(hashes: DataFrame, column: str, limit: int, each: int = 64) -> Bitmap:
    """The bitmap of a column of hashes: `each` bits for every row, at most `limit` (a power of two) however many there are."""
    size = min(limit, 1 << max(6, (each * hashes.count()).bit_length()))
    spot = F.col(column).bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    found = hashes.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = Bitmap(size if found.num_rows else 0)
    if found.num_rows:
        out.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out
