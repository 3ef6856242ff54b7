"""URL filter: host and path rules, and for the rest the ratio of two character language models.

URLs that a rule allows or blocks teach two smoothed Markov models of variable order, of accepted and of rejected URLs. Spark
counts every context of up to ORDER characters, and every context with its next character, over all such URLs; an order whose
context was not seen often enough is left out, so the order varies with the context. The models are tables that grow with the URLs.

What a character adds to a URL's score depends on it and the ORDER characters before it, its gram. So the models are joined to the
distinct grams of the URLs in question, once for each gram, and URLs are scored from the grams: the HOT most frequent ones
are looked up in the tasks, the others are joined, so that no frequent gram is a hot key. A URL is allowed if the difference of the
models' log-likelihoods per character reaches a threshold, chosen on a held-out fifth of the ruled URLs so that both
sides are judged right equally well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import lower_ascii, mix, ragged, signed, slices, staged, text_buffers

ORDER = 5
#: Orders up to LOW have at most 66,000 counts, which tasks carry along; grams that are looked up in the tasks.
LOW, HOT = 1, 100_000
#: A context counts from so many occurrences on; weight of the next shorter order; base alphabet.
SEEN, SMOOTHING, ALPHABET = 2, 4.0, 128
#: Bins of the difference per character, in hundredths, for the threshold.
BIN, BINS = 0.01, 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict for a host with all its subdomains, as far as the path begins with the rule's."""

    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)


RULES = (
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): A-Z of the host lower-cased; both empty for a null or a URL without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and by_rule of the longest rule that fits; null where none does."""
    host, path = split_url(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for one in sorted(rules, key=lambda r: len(r.pattern)):
        fits = one.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, one.pattern).otherwise(rule), F.when(fits, one.verdict).otherwise(verdict)
    return out.withColumns({"rule": rule, "by_rule": verdict})


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(row of each byte, rows' lengths, by order the key of its context, and of the context with the byte)."""
    raw, ends = text_buffers(column)
    raw = lower_ascii(raw)
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    # ORDER zeros before each text stand for its beginning
    place = np.arange(len(raw)) + ORDER * (row + 1)
    padded = np.zeros(len(raw) + ORDER * len(size), np.uint64)
    padded[place] = raw.astype(np.uint64) + np.uint64(1)
    contexts, grams, key = [], [], np.zeros(len(raw), np.uint64)
    for order in range(ORDER + 1):
        if order:
            key = mix(key * np.uint64(257) + padded[place - order] + np.uint64(order << 32))  # contexts of two lengths differ
        contexts.append(key)
        grams.append(mix(key ^ (padded[place] * np.uint64(0x9E3779B97F4A7C15))))
    return row, size, contexts, grams


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts on both sides by order and key, of contexts and of contexts with their next byte."""
    for part in slices(batches, "url"):
        row, _, contexts, grams = _keys(part.column("url"))
        good = part.column("good").to_numpy(zero_copy_only=False).astype(bool)[row]
        for order in range(ORDER + 1):
            for keys in (contexts[order], grams[order]):
                key, at = np.unique(keys, return_inverse=True)
                accepted = np.bincount(at, good, len(key)).astype(np.int64)
                total = np.bincount(at, minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), order, np.int32)), pa.array(signed(key)), pa.array(accepted), pa.array(total - accepted)], ["order", "key", "good", "bad"])


class _Lookup:
    """Values by key; 0 for a key that is not there."""

    def __init__(self, keys: list[int], *values: list):
        keys = np.array(keys, np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [np.array(v, np.float64)[order] for v in values]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(whether each key is there, its values)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), [np.zeros(len(keys)) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return there, [np.where(there, v[at], 0.0) for v in self.values]


def blended(chance, seen, next_, when):
    """The next longer order's chance of a character; `when` picks by condition, for numpy arrays or columns."""
    return when(seen >= SEEN, (next_ + SMOOTHING * chance) / (seen + SMOOTHING), chance)


def _grams(low: _Lookup):
    """Distinct grams of a slice: gram, n, its chances on both sides after the low orders, and its keys of the higher ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "url"):
            _, _, contexts, grams = _keys(part.column("url"))
            gram, first, n = np.unique(grams[ORDER], return_index=True, return_counts=True)
            chances = [np.full(len(gram), 1 / ALPHABET) for _ in range(2)]
            for order in range(LOW + 1):
                seen, next_ = (low.of(signed(x[order][first]))[1] for x in (contexts, grams))
                chances = [blended(c, s, x, np.where) for c, s, x in zip(chances, seen, next_, strict=True)]
            keys = np.stack([x[order][first] for order in range(LOW + 1, ORDER + 1) for x in (contexts, grams)], axis=1)
            lists = ragged(signed(np.ascontiguousarray(keys).ravel()), np.arange(len(gram) + 1) * keys.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(signed(gram)), pa.array(n.astype(np.int64)), *map(pa.array, chances), lists], ["gram", "n", "good", "bad", "keys"])

    return run


def _add_up(hot: _Lookup):
    """Sum over a URL's frequent grams, its length, and the other grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "url"):
            row, size, _, grams = _keys(part.column("url"))
            there, (value,) = hot.of(signed(grams[ORDER]))
            rest = ragged(signed(grams[ORDER][~there]), np.append(0, np.cumsum(np.bincount(row[~there], minlength=len(size)))), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("url"), pa.array(np.bincount(row, value, len(size))), pa.array(size.astype(np.int64)), rest], ["url", "sum", "length", "rest"])

    return run


def models(taught: DataFrame) -> DataFrame:
    """order, key, good, bad: how often each context, and each context with its next byte, came on both sides."""
    return staged(taught.mapInArrow(_tally, "order int, key long, good long, bad long").groupBy("order", "key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "url-models")


def gram_scores(counts: DataFrame, urls: DataFrame) -> DataFrame:
    """gram, n, score (log of its chance on the accepted side over that on the rejected) for all grams of urls."""
    low = counts.filter(F.col("order") <= LOW).collect()  # at most 256 + 1 contexts with 256 next bytes each, and themselves
    table = _Lookup([x["key"] for x in low], [x["good"] for x in low], [x["bad"] for x in low])
    found = urls.mapInArrow(_grams(table), "gram long, n long, good double, bad double, keys array<long>")
    found = found.groupBy("gram").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("good", "bad", "keys")])
    found = staged(found, "url-grams")
    # a context is followed by at most 256 bytes and stands in ever fewer grams the longer it is
    each = found.select("gram", F.posexplode("keys").alias("at", "key")).join(counts.filter(F.col("order") > LOW).select("key", "good", "bad"), "key")
    width = 2 * (ORDER - LOW)
    cell = lambda side, i: F.coalesce(F.max(F.when(F.col("at") == i, F.col(side))), F.lit(0)).alias(f"{side}{i}")
    known = each.groupBy("gram").agg(*[cell(side, i) for side in ("good", "bad") for i in range(width)])
    rows = found.select("gram", "n", "good", "bad").join(known, "gram", "left").fillna(0)

    def chance(side: str) -> Column:
        step = lambda c, i: blended(c, F.col(f"{side}{i}"), F.col(f"{side}{i + 1}"), lambda when, a, b: F.when(when, a).otherwise(b))
        return reduce(step, range(0, width, 2), F.col(side))

    return staged(rows.select("gram", "n", (F.log(chance("good")) - F.log(chance("bad"))).alias("score")), "url-gram-scores")


def differences(counts: DataFrame, urls: DataFrame, hot: int = HOT) -> DataFrame:
    """url, difference (log P(accepted) - log P(rejected) per character; 0 for an empty one) of distinct urls."""
    grams = gram_scores(counts, urls)
    top = grams.orderBy(F.desc("n"), "gram").limit(hot).collect()
    table = _Lookup([x["gram"] for x in top], [x["score"] for x in top])
    summed = staged(urls.mapInArrow(_add_up(table), "url string, sum double, length long, rest array<long>"), "url-sums")
    rest = summed.filter(F.size("rest") > 0).select("url", F.explode("rest").alias("gram")).join(grams, "gram").groupBy("url").agg(F.sum("score").alias("more"))
    value = (F.col("sum") + F.coalesce("more", F.lit(0.0))) / F.greatest("length", F.lit(1))
    return staged(summed.join(rest, "url", "left").select("url", value.alias("difference")), "url-differences")


def threshold(tried: DataFrame) -> float:
    """Where both sides of tried (good, difference) are judged right equally well; 0 if a side has none."""
    bins = F.least(F.greatest(F.floor(F.col("difference") / BIN), F.lit(-BINS)), F.lit(BINS))
    sides = np.zeros((2, 2 * BINS + 2))
    for x in tried.groupBy("good", bins.cast("int").alias("bin")).count().collect():
        sides[int(x["good"]), x["bin"] + BINS] += x["count"]
    if not sides.sum(axis=1).all():
        return 0.0
    share = sides / sides.sum(axis=1, keepdims=True)
    below = np.cumsum(share, axis=1)  # of each side, judged rejected by the threshold after each bin
    right = np.append(0.0, (below[0] - below[1])[:-1])
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[len(best) // 2] - BINS) * BIN)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", hot: int = HOT) -> DataFrame:
    """One row per page: id, host, path, rule (the longest that fits, or null), verdict (the rule's, else the models'), difference (null
    where a rule decides).

    A null or empty URL has no characters: difference 0, as judged by the threshold. If the rules leave one side without URLs, what
    no rule decides is allowed. Repeated rows are judged alike; other columns are not read. No rows in, no rows out.
    """
    rows = ruled(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), rules)
    taught = rows.filter("by_rule is not null").select("url", (F.col("by_rule") == "allow").alias("good"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("apart"))
    counts = models(taught.filter(~F.col("apart")).select("url", "good"))
    sides = counts.filter("order = 0").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not sides["good"] or not sides["bad"]:
        return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), F.when(F.col("by_rule").isNull(), 0.0).alias("difference"))
    tried = taught.filter("apart")
    asked = rows.filter("by_rule is null and url is not null").select("url").union(tried.select("url")).distinct()
    scored = differences(counts, asked, hot)
    limit = threshold(tried.join(scored, "url"))
    open_ = F.col("by_rule").isNull()
    difference = F.when(open_, F.coalesce("difference", F.lit(0.0)))
    verdict = F.coalesce("by_rule", F.when(difference >= limit, "allow").otherwise("block"))
    return rows.join(scored, "url", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), difference.alias("difference"))
