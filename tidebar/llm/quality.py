"""Quality classifier by positive-unlabelled learning.

Only trusted positives and unlabelled web text teach the model; negatives are never shown. With prior p the risk
p E_P[l(+)] + E_U[l(-)] - p E_P[l(-)] is an unbiased estimate of the classification risk; its part for negatives cannot be
below zero, so where the estimate is, the step goes against it (non-negative risk).

The prior is estimated from positives and unlabelled text alone: a first model ranks all unlabelled documents and the half of the
trusted positives that it was not fitted on, and the prior is the least ratio of their shares above any score, with a margin for what the
shares may be off by. All documents of the training folds take part in that, and in the risk: in ROUNDS rounds Spark adds up the unlabelled
part of the risk and its gradient over all documents at the weights of the round, and the steps from there take those sums, plus what a bounded
sample says of how they change on the way (variance reduction). So the sample only stands for small differences, and the weights
settle where the risk over all documents has its least, whatever the sample.

The model is linear over the whole text's hashed runs of byte shapes (small letter, capital, digit, each other byte), hashed byte
trigrams, and how often words come again at once. Of labelled rows at most FIT_POSITIVES positives teach it; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import bounded_sample, give_back, row_of, slices, staged, text_buffers, words_of

#: Slots of the shape runs (of two and of four bytes), word distances at which repeats are counted, slots of the byte trigrams.
SHAPES, LAGS, GRAMS = 512, 4, 1024
DIMENSIONS = 2 * SHAPES + LAGS + GRAMS
TEXT_WEIGHT = 0.25
#: Least deviation by which a feature is scaled.
FLOOR = 0.02
#: Labelled rows that teach at most, and rows of the sample that tells how the sums over all documents change within a round.
FIT_POSITIVES, SAMPLE_ROWS, ROUNDS = 2000, 2500, 3
STEPS, RATE, DECAY = 120, 0.01, 2e-3
#: Bins of the first model's score; chance and share by which the prior's shares may be off.
BINS, DOUBT, MARGIN = 1000, 0.1, 0.01


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(3))


def _shapes() -> np.ndarray:
    """Bytes by their looks: small letters (and letters beyond ASCII) alike, capitals alike, digits alike, all else itself."""
    table = np.arange(256, dtype=np.uint8)
    table[97:123], table[128:], table[65:91], table[48:58] = 97, 97, 65, 48
    return table


SHAPE_OF = _shapes()


def _grams(x: np.ndarray, row: np.ndarray, rows: int, size: int, dimensions: int) -> np.ndarray:
    """Square roots of hashed counts of byte runs, unit length."""
    counts = np.zeros(rows * dimensions, np.int64)
    if len(x) >= size:
        key = np.zeros(len(x) - size + 1, np.uint32)
        for i in range(size):
            key = key * np.uint32(257) + x[i : len(x) - size + 1 + i]
        slot = ((key * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(dimensions)
        inside = row[: len(key)] == row[size - 1 :]
        counts = np.bincount(row[: len(key)][inside] * dimensions + slot[inside], minlength=rows * dimensions)
    counts = counts.reshape(rows, dimensions)
    return np.sqrt(counts, dtype=np.float32) / np.maximum(np.sqrt(counts.sum(axis=1, keepdims=True), dtype=np.float32), 1)


def features(column: pa.Array) -> np.ndarray:
    """Rows x DIMENSIONS; an empty text is all zeros."""
    raw, ends = text_buffers(column)
    rows = len(ends) - 1
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(ends))
    shape = SHAPE_OF[raw]
    words, cuts, _ = words_of(column)
    doc = row_of(cuts)
    repeats = np.zeros((rows, LAGS), np.float32)
    for lag in range(1, LAGS + 1):
        if len(words) > lag:
            same = (words[lag:] == words[:-lag]) & (doc[lag:] == doc[:-lag])
            repeats[:, lag - 1] = np.bincount(doc[lag:], same, rows) / np.maximum(np.diff(cuts), 1)
    return np.hstack([_grams(shape, row, rows, 2, SHAPES), _grams(shape, row, rows, 4, SHAPES), repeats, TEXT_WEIGHT * _grams(raw, row, rows, 3, GRAMS)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, start: np.ndarray | None = None, whole: np.ndarray | None = None, steps: int = STEPS) -> np.ndarray:
    """Weights and, last, the bias; Adam on the non-negative risk of the logistic loss, from `start` on (zero). whole: `unlabelled_sums` of all
    documents at start, each a mean; without it the unlabelled rows are taken for all there are."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + FLOOR
    p, u = ((x - mean) / scale for x in (positive, unlabelled))
    correction, loss = 0.0, 0.0
    w = np.zeros(p.shape[1] + 1, np.float32)
    if start is not None:
        w = np.append(start[:-1] * scale, start[-1] + mean @ start[:-1]).astype(np.float32)
    if whole is not None:
        lack = whole - unlabelled_sums(start, unlabelled) / len(unlabelled)
        correction, loss = np.append((lack[:-2] - lack[-2] * mean) / scale, lack[-2]).astype(np.float32), lack[-1]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = (np.clip(x @ w[:-1] + w[-1], -30, 30) for x in (p, u))
        up, uu = (1 / (1 + np.exp(-z)) for z in (zp, zu))
        # l(+) = log(1 + exp(-z)), l(-) = log(1 + exp(z))
        negative = np.logaddexp(0, zu).mean() + loss - prior * np.logaddexp(0, zp).mean()
        gp, gu = up / len(up), uu / len(uu)

        def grad(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.append(a.astype(np.float32) @ p + b.astype(np.float32) @ u, np.float32(a.sum() + b.sum()))

        down = grad(-prior * gp, gu) + correction
        if negative < 0:
            g = -down
        else:
            g = grad(prior * (up - 1) / len(up), np.zeros(len(uu))) + down
        g[:-1] += DECAY * w[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        w -= np.float32(RATE) * (first / np.float32(1 - 0.9**step)) / (np.sqrt(second / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    w = w.astype(np.float64)
    weights = w[:-1] / scale
    return np.append(weights, w[-1] - mean @ weights)


def unlabelled_sums(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of chance times (features, 1) and, last, of the loss as a negative."""
    z = np.clip(x @ model[:-1] + model[-1], -700, 700)
    score = 1 / (1 + np.exp(-z))
    return np.concatenate([score @ x, [score.sum(), np.logaddexp(0, z).sum()]])


def chances(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ model[:-1] + model[-1], -700, 700)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feature rows as slots and values; at most DIMENSIONS a row whatever the text's length."""
    for part in slices(batches):
        x = features(part.column("text"))
        row, slot = np.nonzero(x)
        offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [part.column("key"), pa.ListArray.from_arrays(offsets, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(x[row, slot], pa.float32()))], ["key", "slots", "counts"]
        )


def _ranked(model: np.ndarray, bins: bool):
    """The bin of each row's score, if asked for, and, last, a task's row with its rows' number and `unlabelled_sums`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 3)
        names = ["key", "bin", "sums"]
        for part in slices(batches):
            x = features(part.column("text"))
            total += np.append(unlabelled_sums(model, x), len(x))
            if bins:
                spot = np.minimum((chances(model, x) * BINS).astype(np.int32), BINS - 1)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(spot), pa.nulls(len(x), pa.list_(pa.float64()))], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names)

    return run


def _means(ranked: DataFrame) -> np.ndarray:
    """`unlabelled_sums` over all rows, divided by their number (DIMENSIONS + 3 numbers come to the driver)."""
    out = np.zeros(DIMENSIONS + 3)
    for x in ranked.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect():
        out[x["pos"]] = x["total"]
    return out[:-1] / max(out[-1], 1)


def estimate_prior(unlabelled: np.ndarray, positive: np.ndarray) -> float:
    """Of counts by bin: the least ratio of shares above a score, at the score where its upper bound is least."""
    n = np.array([max(x.sum(), 1) for x in (unlabelled, positive)])
    above = [np.cumsum(x[::-1])[::-1] / m for x, m in zip((unlabelled, positive), n, strict=True)]
    doubt = np.sqrt(np.log(4 / DOUBT) / (2 * n)).sum()
    some = above[1] > 0
    if not some.any():
        return 0.5
    ratio = above[0][some] / above[1][some]
    best = np.argmin(ratio + (1 + MARGIN) * doubt / above[1][some])
    return float(np.clip(ratio[best], 0.01, 0.999))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray | None:
    """A model from the training folds; None without positives or without documents."""
    named = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id"))
    trusted = named.filter(fold(F.col("id")) != 1).distinct().withColumn("half", F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(2)).cast("int"))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    keyed = keyed.filter(F.col("id").isNotNull() & (fold(F.col("id")) != 1))
    good = keyed.select("id", "key").join(trusted, "id").select("key", "half").distinct()
    drawn = bounded_sample(good, ["key"], FIT_POSITIVES).select("key", F.col("half").alias("side"))
    drawn = drawn.union(bounded_sample(keyed.select("key").distinct(), ["key"], SAMPLE_ROWS, seed=1).select("key", F.lit(2).alias("side")))
    wanted = [tuple(x) for x in drawn.collect()]  # at most FIT_POSITIVES + SAMPLE_ROWS keys
    keys = docs.sparkSession.createDataFrame(sorted({(k,) for k, _ in wanted}) or [(None,)], "wanted long")
    rows = keyed.join(F.broadcast(keys), F.col("key") == F.col("wanted")).select("key", "text").mapInArrow(_sparse, "key long, slots array<int>, counts array<float>")
    place = {k: i for i, k in enumerate(sorted({k for k, _ in wanted}))}
    table, there = np.zeros((len(place), DIMENSIONS), np.float32), np.zeros(len(place), bool)
    for x in rows.dropDuplicates(["key"]).toLocalIterator():
        table[place[x["key"]], x["slots"]] = x["counts"]
        there[place[x["key"]]] = True
    first, second, sample = (table[[place[k] for k, side in wanted if side == n and there[place[k]]]] for n in range(3))
    del table
    if not len(first) + len(second) or not len(sample):
        return None
    pilot = fit(first if len(first) else second, sample, 0.5)
    texts = keyed.select("key", "text")
    kind = "key long, bin int, sums array<double>"
    ranked = staged(texts.mapInArrow(_ranked(pilot, True), kind), "ranked")
    held = ranked.filter("bin is not null").join(good.filter("half = 1"), "key", "left")
    tally = held.groupBy("bin").agg(F.count("*").alias("n"), F.count("half").alias("good")).collect()  # at most BINS rows
    counts = np.zeros((2, BINS))
    for x in tally:
        counts[:, x["bin"]] = x["n"], x["good"]
    prior, positive = estimate_prior(*counts), np.concatenate([first, second])
    model, whole = pilot, _means(ranked)
    for turn in range(ROUNDS):
        model = fit(positive, sample, prior, model, whole)
        if turn + 1 < ROUNDS:
            whole = _means(texts.mapInArrow(_ranked(model, False), kind))
    del positive
    del first, second, sample
    give_back()
    return model


def _score(model: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if model is None:
                score = np.full(part.num_rows, 0.5)
            else:
                score = chances(model, features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("text"), pa.array(score, pa.float64())], ["__row", "text", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All documents with held_out, score (0 to 1, higher: better) and predicted (1 if score >= 0.5).

    labels: doc_id, quality (1 good, else not; null ignored). Only the text is scored, in whole; a null or empty text has the
    score of the bias. Without positive labels or documents to learn from all scores are 0.5. keep: the columns of docs to
    return (all); those with a result's name give way. Repeated rows get equal scores; a null id is in no held-out fold.
    """
    made = ["held_out", "score", "predicted"]
    model = train(docs, labels, id_col, text_col)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    row = F.struct(F.col(id_col).alias("__id"), *[F.col(f"`{c}`") for c in kept if c != text_col])
    keyed = docs.select(row.alias("__row"), F.col(text_col).alias("text"))
    out = keyed.mapInArrow(_score(model), f"__row {keyed.schema['__row'].dataType.simpleString()}, text string, score double")
    columns = [F.col("text").alias(text_col) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in kept]
    held = F.col("__row.__id").isNotNull() & (fold(F.col("__row.__id")) == 1)
    return out.select(*columns, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
