"""Phrase collocation mining by dynamic itemset counting.

Documents are dealt into `shards` shards that are scanned in turn, over and over. All lengths are counted in the same scans: words from the
first shard on, a longer phrase from the shard after that in which both its subphrases (all but its last word, all but its first) reached
the threshold, wherever in the cycle that is. Each phrase is counted for one full cycle; the scans end when no cycle is open.

A count is kept by shard, so what a shard holds of a phrase is known once and for all when it has been scanned for it, and a second look
only finds the same number. Of the phrases in a shard only those are tracked that occur there threshold / shards times or that are tracked
already: a phrase that reaches the threshold in its cycle does so in one shard at least, and from there its cycle goes on
through the others. So the state holds few phrases though most phrases of a corpus are rare.

Tasks learn which phrases are active from bitmaps of their hashes, of at most MAX_BITS bits each whatever the corpus. A phrase whose hash is an
active one's is counted too early; its count is right all the same and it reaches no threshold that its subphrases do not.
Counting itself is by the words, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.llm.common import Bitmap, mix, prefix_hash, row_of, slices, span_hash, staged, text_buffers, word_spans

LONGEST = 4
#: Shards of a cycle; bytes of text that a worker takes at once.
SHARDS, SLICE = 3, 1 << 21
#: Bits of a bitmap (at most 8 MB), and bits for each of its phrases below that.
MAX_BITS, BITS_EACH = 1 << 26, 64
#: Characters that end a piece, and that part words in it.
BREAKS, BLANKS = ".,;:!?\n\x0b\x0c\r", " \t"
_NEXT = np.uint64(0x9FB21C651E98DF25)
#: A phrase's key is its lang, a tab, and its words, which hold no tab.
_COUNTED = ["key", "count", "live"]
_KEY = pa.scalar("\t", pa.large_string())


_LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
#: 0 in words, 1 between words, 2 between pieces.
_CLASS = bytes(2 if chr(c) in BREAKS else 1 if chr(c) in BLANKS else 0 for c in range(256))


def _text_hash(texts: pa.Array) -> np.ndarray:
    raw, ends = text_buffers(texts)
    return span_hash(prefix_hash(raw.astype(np.uint64) + np.uint64(1)), ends[:-1], ends[1:])


def _longer(head: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    return mix(head * _NEXT + word)


def phrase_hash(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """Hashes of phrases, as `_Words.heads` has them."""
    raw, ends = text_buffers(phrases)
    start, end, rows = word_spans(raw != 32, ends)
    word = span_hash(prefix_hash(raw.astype(np.uint64) + np.uint64(1)), start, end)
    out = _text_hash(langs)
    n = np.diff(rows)
    for k in range(int(n.max(initial=0))):
        own = n > k
        out[own] = _longer(out[own], word[rows[:-1][own] + k])
    return out


class Active:
    """What a scan counts: words at all, phrases reached up to now and lately (by length), and phrases whose cycle is open."""

    def __init__(self, words: bool, reached: dict[int, Bitmap], lately: dict[int, Bitmap], tracked: Bitmap):
        self.words, self.reached, self.lately, self.tracked = words, reached, lately, tracked


def _count_slice(part: pa.RecordBatch, active: Active) -> Iterator[pa.RecordBatch]:
    """Occurrences in the texts of a slice: key, count, and whether the phrase is active (else it is tracked only)."""
    raw, ends = text_buffers(part.column("text"))
    lowered = raw.tobytes().translate(_LOWER)
    raw, kind = np.frombuffer(lowered, np.uint8), np.frombuffer(lowered.translate(_CLASS), np.uint8)
    inside = kind == 0
    start, end, rows = word_spans(inside, ends)
    total = len(start)
    if not total:
        return
    offsets = np.append(0, np.cumsum(end - start))
    words = pa.Array.from_buffers(pa.large_binary(), total, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).cast(pa.large_string()).dictionary_encode()
    langs = part.column("lang").dictionary_encode()
    row = row_of(rows)
    code, lang = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
    names, vocabulary = langs.dictionary, words.dictionary
    many = len(vocabulary)
    # two words next to each other are in one piece if no break lies between them
    joined = (row[1:] == row[:-1]) & (np.diff(np.cumsum(kind == 2, dtype=np.int32)[start]) == 0)
    word = _text_hash(vocabulary)[code]
    head = _longer(_text_hash(names)[lang], word)

    def rows_of(n: int, at: np.ndarray, counts: np.ndarray, live: np.ndarray) -> pa.RecordBatch:
        text = [vocabulary.take(pa.array(code[at + k])) for k in range(n)]
        phrase = pc.binary_join_element_wise(*text, pa.scalar(" ", pa.large_string())) if n > 1 else text[0]
        key = pc.binary_join_element_wise(names.take(pa.array(lang[at])).cast(pa.large_string()), phrase, _KEY)
        return pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(counts, pa.int64()), pa.array(live)], _COUNTED)

    own = lang * many + code
    at = np.arange(total) if active.words else np.flatnonzero(active.tracked.has(head))
    if len(at):
        _, first, counts = np.unique(own[at], return_index=True, return_counts=True)
        yield rows_of(1, at[first], counts, np.full(len(first), active.words))
    if active.words:
        sums = np.bincount(lang, minlength=len(names))
        seen = np.flatnonzero(sums)
        key = [f"{x}\t" for x in names.take(pa.array(seen)).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(sums[seen], pa.int64()), pa.array(np.ones(len(seen), bool))], _COUNTED)
    whole, places, live = np.ones(total, bool), {}, {}
    for n in range(2, LONGEST + 1):
        if total < n:
            break
        old, late = active.reached[n - 1].has(head), active.lately[n - 1].has(head)
        whole = whole[:-1] & joined[n - 2 :]
        head = _longer(head[:-1], word[n - 1 :])
        live[n] = old[:-1] & old[1:] & (late[:-1] | late[1:])
        places[n] = np.flatnonzero(whole & (live[n] | active.tracked.has(head)))
    # exact names of phrases: a pair is two words, three words are a pair and a word, four are two pairs
    none = np.zeros(0, np.int64)
    p2, p3, p4 = (places.get(n, none) for n in (2, 3, 4))
    need = np.unique(np.concatenate([p2, p3, p4, p4 + 2]))
    if not len(need):
        return
    _, pair = np.unique(own[need] * many + code[np.minimum(need + 1, total - 1)], return_inverse=True)
    pair_at = lambda p: pair[np.searchsorted(need, p)]
    for n, at, key in ((2, p2, pair_at(p2)), (3, p3, pair_at(p3) * many + code[p3 + 2]), (4, p4, pair_at(p4) * (int(pair.max()) + 1) + pair_at(p4 + 2))):
        if len(at):
            _, first, counts = np.unique(key, return_index=True, return_counts=True)
            yield rows_of(n, at[first], counts, live[n][at[first]])


def _count(active):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE, rows=1 << 16):
            yield from _count_slice(part, active.value)

    return run


def _bits(size: int):
    """Set bits of the bitmaps that a tracked phrase belongs to: map, word of the bitmap, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spot = phrase_hash(batch.column("lang"), batch.column("phrase")) & np.uint64(size - 1)
                bits = (np.uint64(1) << (spot & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("maps"), pa.array((spot >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["maps", "word", "bits"])

    return run


_PHRASE = "substring_index(key, '\t', -1)"
_LANG = f"left(key, char_length(key) - char_length({_PHRASE}) - 1)"
_WORDS = f"CASE WHEN endswith(key, '\t') THEN 0 ELSE size(split({_PHRASE}, ' ')) END"


def _bitmaps(state: DataFrame, step: int, shards: int) -> tuple[Active, int]:
    """What the scan after `step` counts, and the last step at which a cycle is open (at most a few numbers and MAX_BITS bits a map come here)."""
    reach, seen = F.col("reached"), F.col("tracked")
    short = F.col("n").between(1, LONGEST - 1)
    sizes = state.agg(F.count("*").alias("rows"), F.max(F.when(short, reach)).alias("reached"), F.max(F.when(F.col("n") > 0, seen)).alias("tracked")).first()
    last = max(shards - 1, shards + (-1 if sizes.reached is None else sizes.reached), shards - 1 + (sizes.tracked or 0))
    bits = min(MAX_BITS, 1 << max(6, (BITS_EACH * sizes.rows).bit_length()))
    maps = F.array_compact(F.array(
        F.when(short & reach.isNotNull(), F.concat(F.lit("r"), F.col("n"))), F.when(short & (reach > step - shards), F.concat(F.lit("l"), F.col("n"))), F.when((F.col("n") > 0) & (seen > step + 1 - shards), "t")
    ))
    rows = state.select(F.expr(_LANG).alias("lang"), F.expr(_PHRASE).alias("phrase"), maps.alias("maps")).filter("size(maps) > 0").mapInArrow(_bits(bits), "maps array<string>, word long, bits long")
    found = rows.select(F.explode("maps").alias("map"), "word", "bits").groupBy("map", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    kinds, place, value = (found.column(c).combine_chunks() for c in ("map", "word", "bits"))
    made = {}
    for name in [*(f"{k}{n}" for k in "rl" for n in range(1, LONGEST)), "t"]:
        own = pc.equal(kinds, name).to_numpy(zero_copy_only=False)
        made[name] = Bitmap(bits if own.any() else 0)
        if own.any():
            made[name].words[place.to_numpy()[own]] = value.to_numpy()[own].view(np.uint64)
    pick = lambda k: {n: made[f"{k}{n}"] for n in range(1, LONGEST)}
    return Active(step + 1 < shards, pick("r"), pick("l"), made["t"]), last


def count_phrases(docs: DataFrame, threshold: int, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Phrases of 1 to LONGEST words that occur `threshold` times in their lang: lang, n (words), phrase, f; and n = 0, phrase '' with all
    word occurrences of each lang.

    A-Z are lower-cased, a text is cut into pieces at BREAKS and a piece into words at BLANKS; a null lang is `und`, a null or empty text has no words."""
    spark = docs.sparkSession
    # rows are dealt in turn, so that copies, which often come together, do not fill one shard
    shard = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"), shard)
    path = staged(rows.filter("text <> ''"), "phrase-shards", by="shard")
    least = -(-threshold // shards)
    slots = [f"f{i}" for i in range(shards)]
    state, step, last, old = None, 0, shards - 1, None
    active, last = Active(True, *[{n: Bitmap(0) for n in range(1, LONGEST)} for _ in "rl"], Bitmap(0)), shards - 1
    while step <= last:
        told = spark.sparkContext.broadcast(active)
        found = path.filter(F.col("shard") == step % shards).select("lang", "text").mapInArrow(_count(told), "key string, count long, live boolean")
        found = found.groupBy("key").agg(F.sum("count").alias("count"), F.max("live").alias("live"))
        slot = slots[step % shards]
        if state is None:
            both = found.select("key", "count", "live", *[F.lit(None).cast("long").alias(s) for s in slots], *[F.lit(None).cast("int").alias(c) for c in ("n", "tracked", "reached")])
        else:
            both = found.join(state, "key", "full")
        both = both.filter((F.col("live") & (F.col("count") >= least)) | F.endswith("key", F.lit("\t")) | F.col("tracked").isNotNull())
        both = both.withColumns({slot: F.coalesce("count", slot), "n": F.coalesce("n", F.expr(_WORDS))})
        f = sum((F.coalesce(s, F.lit(0)) for s in slots), F.lit(0))
        both = both.withColumns({"tracked": F.coalesce("tracked", F.lit(step)), "reached": F.coalesce("reached", F.when(f >= threshold, step))})
        # a phrase whose cycle is over without reaching the threshold is done with
        both = both.filter((F.col("n") == 0) | F.col("reached").isNotNull() | (F.col("tracked") > step + 1 - shards))
        state = staged(both.select("key", "n", *slots, "tracked", "reached"), "phrase-counts")
        told.destroy()
        active, last = _bitmaps(state, step, shards)
        step += 1
    return state.select(F.expr(_LANG).alias("lang"), "n", F.expr(_PHRASE).alias("phrase"), f.alias("f")).filter((F.col("n") == 0) | (F.col("f") >= threshold))


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, redundant: int = 80, shards: int = SHARDS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each lang's first `top` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Candidates occur a >= threshold times within pieces (see count_phrases). Cut after its first k words, with l and r occurrences of the
    parts, a phrase scores floor(2000000 a / (l + r)); the lowest cut counts, ties to the smallest k. A candidate goes whose words lie contiguously in a
    longer candidate with 100 f >= redundant * a. Order: score, then a, descending, then phrase ascending by its bytes. n: word
    occurrences of the lang. Null lang: und; null or empty texts count nothing, repeated rows count each, an empty table gives no
    rows; other columns of docs are not looked at. Sums and products are decimals, so none overflows."""
    frequent = staged(count_phrases(docs, threshold, shards, lang_col, text_col), "phrases")
    words = frequent.filter("n >= 2").withColumn("words", F.split("phrase", " "))
    # longer candidates name the phrases inside them
    run = lambda size: F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda i: F.array_join(F.slice("words", i, size), " "))
    inner = [F.when(F.col("n") > size, run(size)) for size in range(2, LONGEST)]
    inside = words.filter("n >= 3").select("lang", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*inner))))).alias("phrase"), "f")
    longest = inside.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    big = lambda c: F.col(c).cast("decimal(20,0)")
    kept = words.join(longest, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (big("around") * 100 < big("f") * F.lit(redundant)))
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("words", k + 1, F.col("n") - k), " ").alias("tail"))))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), parts.alias("c")).select("lang", "phrase", "a", "c.*")
    known = frequent.filter(F.col("n").between(1, LONGEST - 1))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumns({"dividend": F.lit(2_000_000).cast("decimal(10,0)") * big("a"), "divisor": big("l") + big("r")}).withColumn("score", F.expr("dividend div divisor"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "a", "b.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = frequent.filter("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
