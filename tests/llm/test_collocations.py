"""Phrases against a plain count, whatever the shards, bitmaps and slices."""

import random

import brute
import pytest

from tidebar.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def corpus(seed, n=60):
    draw = random.Random(seed)
    words = ["Red", "blue", "sky", "a", "b", "é", "x\x00y"]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "!"]) for _ in range(draw.randint(0, 60)))
        rows.append((draw.choice(["en", "de", None, "und"]), text, i))
    rows += [("en", None, 1), ("en", "", 1), ("fr", "...", 2), ("en", "same words here again. " * 3, 3), *[("de", "late late phrase of four", 4)] * 8]
    return rows


def found(docs, **kw):
    out = collocations.collocations(docs, **kw)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("threshold, shards, top", [(5, 3, 2000), (2, 1, 2000), (7, 2, 10)])
def test_against_a_plain_count(spark, threshold, shards, top):
    rows = corpus(threshold)
    docs = spark.createDataFrame(rows, "lang string, text string, rank int").repartition(3)
    got = found(docs, threshold=threshold, shards=shards, top=top)
    assert got == sorted(brute.collocations([r[:2] for r in rows], threshold, top)) and got


def test_tiny_bitmaps_change_nothing(spark, monkeypatch):
    """Nearly every phrase looks active or tracked; counts stay those of the words and the scans end."""
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    rows = corpus(11)
    docs = spark.createDataFrame(rows, "lang string, text string, rank int")
    assert found(docs, threshold=4, shards=2) == sorted(brute.collocations([r[:2] for r in rows], 4))


def test_hot_copies_and_a_long_text(spark):
    rows = [("en", "one two three four five", 0)] * 300 + [("en", "one two " * 20000, 1)]
    docs = spark.createDataFrame(rows, "lang string, text string, k int").repartition(4)
    assert found(docs) == sorted(brute.collocations([r[:2] for r in rows]))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert found(docs) == []
    assert found(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")) == []
