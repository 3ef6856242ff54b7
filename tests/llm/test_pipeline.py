import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest
from brute import contamination, near_duplicates, substring

from tidebar.llm import queries, quality
from tidebar.llm.common import staged

FOLDER = "/root/testdata/sf0.001"


def test_each_stage_against_its_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = rows(docs), staged(stage(spark, docs, FOLDER), "test")
        after = rows(out)
        assert out.columns == columns and set(i for i, _ in after) <= set(i for i, _ in before)
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {i for i, _ in after}
            held = [i for i, q in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1 and q is not None]
            assert sum((i in kept) == (labels[i] == 1) for i in held) >= 0.75 * len(held) > 0 and dict(after).items() <= dict(before).items()
        elif name == "minhash near-dedup":
            assert {i for i, _ in after} == set(near_duplicates(before).values())
        elif name == "substring dedup":
            want = {i: removed for i, _, removed, _ in substring(before, 35)}
            assert all((t == dict(before)[i]) == (not want[i]) for i, t in after) and len(after) == len(before)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            assert {i for i, _ in after} == {r[0] for r in contamination(before, items) if not r[-1]}
        docs = out
    check_packed(corpus_pipeline.packed(spark, docs, FOLDER).collect(), rows(docs))


def check_packed(pieces, rows):
    """Every token of every document once, in order, in sequences without gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], [*range(head, len(ids) + 1, 1024)])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = collections.defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = [a + n for a, n in sorted(own)]
        assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= 1024


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls everywhere, repeated rows, very long and empty texts, and columns with the operators' own names."""
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("odd")
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."
    texts = [(i, prose(60)) for i in range(120)] + [(200 + i, " ".join(w + "%%%" for w in prose(40).split())) for i in range(40)]
    one = prose(90)
    texts += [(400, one), (401, one), (401, one), (None, one), (402, None), (403, ""), (None, None), (404, "long " * 120_000), (405, prose(30_000)), (406, "zq zr zs zt zu zv zw zx zy zz " + prose(20))]
    docs = spark.createDataFrame([(i, t, None if k % 9 == 0 else "en", "web", len(t or ""), 1.0, "c", 7) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int, score double, kept_text string, piece int")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.select("doc_id", (docs.doc_id < 200).cast("int").alias("quality")).distinct().write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "ZQ zr zs zt zu zv zw zx zy zz"), (2, None), (None, "a")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_take_odd_rows(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = staged(stage(spark, docs, odd_folder), "odd")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    left = [(r.doc_id, r.text) for r in docs.collect()]
    ids = [i for i, _ in left]
    assert ids.count(400) == 1 and 401 not in ids and 406 not in ids and ids.count(None) == 2 and {402, 403, 405} <= set(ids)
    check_packed(corpus_pipeline.packed(spark, docs, odd_folder).collect(), left)
    scored = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{odd_folder}/documents.parquet"), odd_folder)
    assert scored.columns == docs.columns and 100 < scored.count() < 170


def test_stages_take_empty_tables(spark, odd_folder):
    docs = spark.read.parquet(f"{odd_folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd_folder).count() == 0
    assert quality.classify(docs, spark.read.parquet(f"{odd_folder}/labels.parquet").limit(0)).count() == 0


def test_every_operator_is_registered():
    names = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
