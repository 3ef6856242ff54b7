import random
import zlib

from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
import pytest

from tidebar.llm import quality


def rows_of(n=1500):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 80))]
        good = rng.random() < 0.8
        docs.append((i, " ".join(words).capitalize() + "." if good else " ".join(w + rng.choice(["%%%", "###"]) for w in words)))
        if rng.random() < 0.5:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = rows_of()
    d, y = spark.createDataFrame(docs + [(9000, None), (9001, ""), (None, "Null id.")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(d, y).collect()}
    assert len(out) == len(docs) + 3 and out[None].held_out is False
    held = [(out[i], g) for i, g in labels if out[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.values() if r.doc_id is not None)
    assert sum(r.predicted == g for r, g in held) >= 0.97 * len(held) > 0
    # held-out labels teach nothing: turned round, they change no score
    turned = y.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(d, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in out.items())


def test_without_anything_to_learn(spark):
    d, y = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.classify(d, y).collect()] == [(0.5, 1)] * 2
    assert quality.classify(d.limit(0), y).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled_text(share):
    rng = np.random.default_rng(1)
    bins = lambda n, a, b: np.bincount((rng.beta(a, b, n) * quality.BINS).astype(int), minlength=quality.BINS)
    mixed = bins(int(40_000 * share), 8, 2) + bins(int(40_000 * (1 - share)), 2, 8)
    assert abs(quality.estimate_prior(mixed, bins(6000, 8, 2)) - share) < 0.05
    assert quality.estimate_prior(mixed, np.zeros(quality.BINS)) == 0.5


def test_the_step_follows_the_risk():
    """The gradient that the fit follows is that of the risk, by differences; the correction adds what the sample lacks of all documents."""
    rng = np.random.default_rng(2)
    p, u = rng.standard_normal((40, 6)).astype(np.float32) + 0.4, rng.standard_normal((90, 6)).astype(np.float32)
    more = rng.standard_normal((500, 6)).astype(np.float32)
    risk = lambda w, un: 0.3 * np.logaddexp(0, -(p @ w[:-1] + w[-1])).mean() + np.logaddexp(0, un @ w[:-1] + w[-1]).mean() - 0.3 * np.logaddexp(0, p @ w[:-1] + w[-1]).mean()
    at = rng.standard_normal(7) * 0.1
    slope = lambda un: np.array([(risk(at + 1e-5 * e, un) - risk(at - 1e-5 * e, un)) / 2e-5 for e in np.eye(7)])
    mean = lambda un: quality.unlabelled_sums(at, un) / len(un)
    assert np.allclose(slope(more) - slope(u), (mean(more) - mean(u))[:-1], atol=1e-6)
    assert np.isclose((mean(more) - mean(u))[-1], risk(at, more) - risk(at, u))
    fitted = quality.fit(p, u, 0.3, steps=400)
    start = quality.fit(p, u, 0.3, steps=1)
    assert risk(fitted, u) < risk(start, u) < risk(np.zeros(7), u) + 1e-6


def test_rounds_find_the_least_risk_over_all_documents_from_a_small_sample():
    """Forty rows of a thousand tell how sums change; the weights come as near the fit on all thousand as no fit on the forty does."""
    rng = np.random.default_rng(5)
    p, u = rng.standard_normal((60, 6)).astype(np.float32) + 0.8, rng.standard_normal((1000, 6)).astype(np.float32)
    few = u[:40]
    risk = lambda w: 0.3 * np.logaddexp(0, -(p @ w[:-1] + w[-1])).mean() + np.logaddexp(0, u @ w[:-1] + w[-1]).mean() - 0.3 * np.logaddexp(0, p @ w[:-1] + w[-1]).mean()
    model = quality.fit(p, few, 0.5)
    for _ in range(6):
        model = quality.fit(p, few, 0.3, model, quality.unlabelled_sums(model, u) / len(u), steps=300)
    best, alone = quality.fit(p, u, 0.3, steps=2000), quality.fit(p, few, 0.3, steps=2000)
    assert risk(model) - risk(best) < 0.2 * (risk(alone) - risk(best)) and risk(model) < risk(best) + 5e-3


def test_a_small_sample_changes_few_verdicts(spark, monkeypatch):
    docs, labels = rows_of()
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    verdicts = []
    for rows in (1500, 150):
        monkeypatch.setattr(quality, "SAMPLE_ROWS", rows)
        verdicts.append({r.doc_id: r.predicted for r in quality.classify(d, y).collect()})
    assert sum(verdicts[0][i] == verdicts[1][i] for i in verdicts[0]) >= 0.98 * len(docs)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One two. Two!", "", None, "äöü 123 " * 40_000, "x"]
    whole = quality.features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.features(pa.array([t], pa.string()))[0], atol=1e-6)
    assert not whole[1].any() and whole.shape == (5, quality.DIMENSIONS)


def test_clashing_columns_and_repeated_rows(spark):
    docs, labels = rows_of(300)
    d = spark.createDataFrame([(*r, 0.0, "k") for r in docs + docs[:40] + [(7, "word " * 100_000)] * 2], "doc_id long, text string, score double, good string")
    out = quality.classify(d, spark.createDataFrame(labels + labels[:9], "doc_id long, quality int"))
    assert out.columns == ["doc_id", "text", "good", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 342 and all(r.good == "k" and 0 <= r.score <= 1 for r in rows)
    by = {}
    assert all(abs(by.setdefault((r.doc_id, r.text), r.score) - r.score) < 1e-9 for r in rows)
