"""The transducer against a sorted list, and the audit against a plain count, whatever the sizes of its blocks, tiles and rounds."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.llm import divergence
from tidebar.llm.divergence import Ranges, Transducer

WORDS = ["the", "then", "thens", "a", "an", "and", "ändern", "日本", "zebra", "zeb", "Upper", "q" * 300, "ü"]


def buffers(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    return data, np.append(0, np.cumsum(list(map(len, words)))).astype(np.int64)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), min_size=1, max_size=60), st.lists(st.binary(min_size=1, max_size=7), min_size=1, max_size=40))
def test_transducer_gives_places_in_order(terms, asked):
    ordered = sorted(terms)
    machine = Transducer.load(Transducer.build(ordered).dump())
    assert machine.terms() == ordered
    asked = asked + ordered
    want = [ordered.index(w) if w in terms else -1 for w in asked]
    assert machine.places(*buffers(asked)).tolist() == want
    cuts = range(0, len(ordered), 7)
    ranges = Ranges([(i, ordered[i], Transducer.build(ordered[i : i + 7])) for i in cuts])
    assert ranges.ordinals(*buffers(asked)).tolist() == want


def test_transducer_is_minimal():
    """Equal endings are one path: as many states as there are different sets of endings."""
    terms = sorted(a + b for a in (b"read", b"walk", b"talk") for b in (b"", b"ed", b"er", b"ing"))
    endings = {frozenset(t[len(p) :] for t in terms if t.startswith(p)) for t in terms for p in (t[:k] for k in range(len(t) + 1))}
    assert len(Transducer.build(terms).final) == len(endings)


def corpus(seed, n=120):
    draw = random.Random(seed)
    rows = []
    for _ in range(n):
        text = "".join(draw.choice(WORDS) + draw.choice([" ", "1", ". ", "\n", "[", "`"]) for _ in range(draw.randint(0, 12)))
        rows.append((draw.choice(["en", "de", None]), draw.choice(["web", "news", "böse", "a", None, "z"]), text))
    return rows + [("en", "empty", None), ("en", "blank", ""), ("xx", "alone", "seldom"), ("xx", "other", "words"), ("yy", "single", "the the")]


def found(spark, rows, **kw):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, value int").repartition(3)
    out = divergence.audit(docs, **kw)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("least, top", [(1, 3), (10, 50)])
def test_against_a_plain_count(spark, least, top):
    rows = corpus(least)
    assert found(spark, rows, least=least, top=top) == sorted(brute.divergence(rows, least, top))


def test_small_blocks_tiles_and_rounds_change_nothing(spark, monkeypatch):
    for name, value in {"BLOCK": 2, "ROUND_BYTES": 900, "TILE": 2, "CELLS": 8, "HELD": 3}.items():
        monkeypatch.setattr(divergence, name, value)
    # tasks import the module anew, so only what the driver plans with is small there
    rows = corpus(5, 60)
    docs = spark.createDataFrame([(a or "", b or "", c or "") for a, b, c in rows], "lang string, source string, text string")
    assert divergence.transducers(divergence.kept_terms(docs, 2)).count() > 3
    monkeypatch.undo()
    for name, value in {"ROUND_BYTES": 900, "TILE": 2, "CELLS": 8}.items():
        monkeypatch.setattr(divergence, name, value)
    assert found(spark, rows, least=2, top=5) == sorted(brute.divergence(rows, 2, 5))


def test_counts_beyond_64_bits_of_product(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000, 3)], "n long, total long, terms long")
    got = divergence.with_share(rows, "p", "n", "total", "terms").first().p
    assert got == 1 + 1_000_000_000 * (9_000_000_000_000 + 5) // (10_000_000_000_000 + 15)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(docs).count() == 0


def test_hot_source_with_copies(spark):
    rows = [("en", "hot", "the same the")] * 400 + [("en", f"s{i}", "the other") for i in range(40)]
    assert found(spark, rows) == sorted(brute.divergence(rows))
