"""Ids and texts against the tokenizers library, pieces of every length, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebar.llm import bpe, queries
from tidebar.llm.tokens import tokenizer

PARTS = ["the", " quick", "ness", "aaaa" * 30, "été", " 日本語テキスト", "don't", "’s", "\n\n  x", "<|endoftext|>", "12345", " ", "🙂🙂", "ab" * 200, "\t", "á", "<|endof", "\x00\x7f"]


def texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def plain(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids


def test_ids_and_texts_are_those_of_the_library():
    rows = [*texts(300), None, "", "a", "a" * 20000, "".join(chr(random.Random(2).randint(32, 0x3000)) for _ in range(2000))]
    ids, cuts = bpe.TreeEncoder().encode(pa.array(rows))
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])] == [plain(t) for t in rows]
    assert bpe.texts_of(ids.astype(np.int64), cuts, bpe.vocabulary()).to_pylist() == [t or "" for t in rows]


@pytest.mark.parametrize("size", [*range(1, 12), 31, 32, 33, 63, 64, 65, 66, 67, 300])
def test_trees_side_by_side_and_alone_agree(size):
    v, draw = bpe.vocabulary(), random.Random(size)
    pieces = ["".join(draw.choice("aeinrst") for _ in range(size)).encode() for _ in range(40)]
    want = [tokenizer().encode(p.decode()).ids for p in pieces]
    assert [v.merge_one(p) for p in pieces] == want == v.merge(pieces)
    if 1 < size <= bpe.LONG + 1:
        assert v.merge_many(pieces, 1 << (size - 2).bit_length() if size > 2 else 1) == want


def test_decoding_as_the_library_does():
    rows = [[], [50256, 262], [447], [447, 247], [220, 50256, 50256], [128, 129, 130]]
    flat, cuts = np.concatenate([np.array(r, np.int64) for r in rows]), np.append(0, np.cumsum(list(map(len, rows))))
    assert bpe.texts_of(flat, cuts, bpe.vocabulary()).to_pylist() == [tokenizer().decode(r, skip_special_tokens=False) for r in rows]
    assert bpe.texts_of(np.array([-1, 60000, 262]), np.array([0, 3]), bpe.vocabulary()).to_pylist() == [" the"]


def test_rows_of_every_kind(spark):
    rows = [(1, t, i, "x") for i, t in enumerate(texts(40, 3))] + [(None, None, 0, None), (2, "", 1, "y"), (2, "", 1, "y"), (3, "long " * 50000, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, decoded string").repartition(3)
    got = bpe.encode(docs)
    assert got.columns == ["doc_id", "text", "decoded", "ids", "n_tokens"] and got.count() == len(rows)
    assert all(r.ids == plain(r.text) and r.n_tokens == len(r.ids) for r in got.collect())
    back = bpe.decode(got)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    odd = spark.createDataFrame([(1, None), (2, [None, 262, 99999])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(odd).collect()} == {1: "", 2: " the"}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_query_against_the_library(spark):
    import hashlib

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_bpe(spark, folder).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = plain(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tokenizer().decode(ids, skip_special_tokens=False)))
    assert queries.op13_bpe(spark, folder).filter(F.col("n_tokens") < 0).count() == 0
