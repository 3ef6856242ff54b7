import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import Union, contamination, near_duplicates, substring

from tidebar.llm.components import components, merged
from tidebar.llm import decontaminate, minhash, packing, substring_dedup, tokens

DOCS = "doc_id long, text string"


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["a", "b", "the", "The", "of", "x1", "é", "zu", "Ü.", "end,"] + [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [rng.choice(words) for _ in range(200)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 120))]
        kind = i % 8
        if kind == 1:
            w[5:5] = passage
        elif kind == 2:
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 3:
            w = ["a"] * rng.randint(1, 90)
        elif kind == 4:
            w = ["a", "b"] * rng.randint(10, 40)
        elif kind == 5:
            w = w + passage[3:50] + w
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(n, None), (n + 1, ""), (n + 2, "   "), (n + 3, rows[2][1]), (n + 4, "é" * 5), (n + 5, " ".join(base * 30)), (n + 6, " ".join(["a"] * 5000))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_substring_dedup_against_brute_force(spark, seed):
    rows = corpus(seed)
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(substring(rows, 35))


def test_substring_dedup_edges(spark):
    rows = [(7, "x y " * 40), (7, "p q " * 40), (None, "only once"), (8, "same " * 50), (8, "same " * 50)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], DOCS + ", n_words int, kept_text string")
    out = substring_dedup.substring_dedup(df)
    assert out.columns == ["doc_id", "text", "n_words", "n_removed", "kept_text", "kept_sha256"]
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=key) == sorted(substring(rows, 35), key=key)
    assert substring_dedup.substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_substring_dedup_tells_windows_of_one_hash_apart(spark):
    """Two sequences with equal first hashes are equal only if the second agrees."""
    n = np.arange(6)
    same = np.full(6, 7, np.uint64)
    for checks, want in ((np.array([1, 1, 2, 3, 3, 4], np.uint64), [0, 1, 3, 4]), (same[:0], [0, 1, 2, 3, 4, 5])):
        dealt = [next(iter(substring_dedup._deal(same[i : i + 1], checks[i : i + 1], n[i : i + 1], n[i : i + 1], 1))) for i in range(6)]
        back = substring_dedup._repeated(pa.Table.from_batches(dealt).to_pandas())
        assert sorted(x for ids in back["ids"] for x in ids) == want


def test_recompression_names_equal_substrings_alike():
    rng = np.random.default_rng(3)
    for alphabet in (2, 5, 200):
        a, b, same = (rng.integers(0, alphabet, n).astype(np.uint64) for n in (50, 70, 60))
        words = np.concatenate([a, same, b, same, a])
        edges = np.zeros(len(words), bool)
        edges[0] = edges[180] = True
        name, lo, hi = substring_dedup.recompress(words, edges)
        inside = lambda s: {(n, x - s, y - s) for n, x, y in zip(name.tolist(), lo.tolist(), hi.tolist()) if s <= x and y <= s + 60}
        assert inside(50) == inside(180)


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_decontamination_against_brute_force(spark, bits, monkeypatch):
    """Whatever the bitmaps let through, and with ids that come with other texts too."""
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)
    rows = corpus(5)
    items = [(1, " ".join(rows[1][1].split()[3:40])), (2, "x1 ZU"), (2, "é"), (30, rows[9][1]), (4, None), (5, ""), (None, "the of"), (6, "a a a a a a a a a a a"), (30, rows[9][1]), (10, "q r s t u v w x y z"), (11, "b c d e f g h i j k")]
    rows += [rows[1], (rows[1][0], "q r s t u v w x y z x y"), (rows[1][0], "m n o p b c d e f g h i j k"), (rows[1][0], "y z"), (None, "q r s t u v w x y z")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for keep in (None, ["doc_id"]):
        out = decontaminate.decontaminate(docs.repartition(3), bench, keep=keep)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()), key=str)
        assert got == sorted(contamination(rows, items), key=str)
        assert out.columns[: len(keep or docs.columns)] == (keep or docs.columns)


def test_decontamination_with_text_ids_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    rows = [(1, long), (2, long + " passage " + "q r s t u v w x y z"), (2, None), (3, "")]
    items = [("b", "q r s t u v w x y z"), ("a10", "Q, r s t u v w x y z!"), ("a9", " ".join(f"w{i}" for i in range(40)))]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], DOCS + ", n_hit int, word string")
    out = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"))
    assert out.columns == ["doc_id", "text", "word", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()) == sorted(contamination(rows, items))


def test_decontamination_with_empty_tables(spark):
    empty, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(empty, bench).count() == 0
    out = decontaminate.decontaminate(spark.createDataFrame([(1, "a b c")], DOCS), bench.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(3, 0, False)]


@pytest.mark.parametrize("seed", range(2))
def test_minhash_against_brute_force(spark, seed):
    rows = corpus(seed, 56)
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in out} == near_duplicates(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_minhash_large_bucket_of_near_copies(spark):
    """A family around one text: its members are like the text, though not all like one another."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(100, " ".join(base))]
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(300), 6):
            w[k] = f"z{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(f"u{rng.randrange(9000)}" for _ in range(100))) for i in range(20)] + [(300, None), (301, None), (302, rows[0][1])]
    out = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: r.component_id for i, r in out.items()} == near_duplicates(rows)
    assert out[302].copy_of == 100
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    nulls = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in nulls) == [(-1, -1, True), (1, 1, True)]


def test_minhash_meets_every_pair_of_a_large_bucket(spark):
    """One large family and many small ones share a bucket: members of small families meet one another too."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(120)]
    rows = []
    for family, members in enumerate([300] + [2] * 40):
        own = [f"f{family}x{i}" for i in range(80)]
        for _ in range(members):
            w = common + own
            w[rng.randrange(120, 200)] = f"z{len(rows)}"
            rows.append((1000 + len(rows), " ".join(w)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), bands=2, rows=1).collect()
    batch = pa.RecordBatch.from_pylist([{"id": i, "text": t} for i, t in rows])
    signed = [(i, b) for part in minhash._sign(2, 1)(iter([batch])) for i, b in zip(part.column("id").to_pylist(), part.column("bands").to_pylist())]
    shared = [(i, j) for x, (i, p) in enumerate(signed) for j, q in signed[:x] if set(p) & set(q)]
    near, union = near_duplicates(rows), Union()
    for i, j in shared:
        if near[i] == near[j]:  # any two of a family are alike
            union.join(i, j)
    found = {i: union.find(i) for i, _ in rows}
    assert sum(i != c for i, c in found.items()) > 320
    assert {r.doc_id: r.component_id for r in out} == found


def test_minhash_with_text_ids_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [("b", " ".join(base)), ("a", " ".join([*base[:119], "z"])), ("a", "something else here entirely so"), ("c", "something else here entirely so"), ("d", "long " * 200_000), ("e", "long " * 200_001), ("f", "x"), (None, "x")]
    df = spark.createDataFrame([(*r, "k", 5) for r in rows], "doc_id string, text string, component_id string, similarity int")
    out = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert out == [("None", "None", True), ("a", "a", True), ("a", "a", True), ("b", "a", False), ("c", "a", False), ("d", "d", True), ("e", "d", False), ("f", "f", True)]


def test_components_and_merging(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    union = Union()
    for a, b in edges:
        union.join(a, b)
    want = {i: union.find(i) for e in edges for i in e}
    label = None
    for at in (0, 90, 180):
        label = merged(label, df(edges[at : at + 90] if at < 180 else edges[at:]))
    for found in (components(df(edges)), label):
        assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    element = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(1, 12, 300), rng.integers(1, 12, 300)
    a[:40], b[250:] = 0, 0
    x, y = np.flatnonzero(a), np.flatnonzero(b)
    sign = minhash.signatures(np.append(element[x], element[y]), np.append(np.zeros(len(x), int), np.ones(len(y), int)), np.append(a[x], b[y]), 2, 6000)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def plain_tokenizer():
    """As anyone would load it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_texts(n):
    rng = random.Random(2)
    parts = [*"abst'rvmld  \n\té\u00a0\u0085²12!%.", "'s", "'re", "'ll", "'Ve", " ", "中", "\U0001f600", "<|endoftext|>", "Ā", "ɐ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", None, " ", "'s", "x" * 3000, "a <|endoftext|> b"]


def test_encoder_equals_tokenizer():
    texts = token_texts(4000)
    ids, cuts = tokens.Encoder().encode(pa.array(texts))
    want = [x.ids for x in plain_tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want
    assert want[-1] == [64, 220, 50256, 275]


def test_encoder_survives_equal_hashes_and_a_full_cache(monkeypatch):
    texts = [t for t in token_texts(300) if t]
    want = [x.ids for x in plain_tokenizer().encode_batch(texts, add_special_tokens=False)]
    whole = tokens.span_hash
    monkeypatch.setattr(tokens, "span_hash", lambda *a: whole(*a) % np.uint64(50))
    monkeypatch.setattr(tokens, "CACHE_PIECES", 20)
    encoder = tokens.Encoder()
    for at in range(0, len(texts), 50):
        ids, cuts = encoder.encode(pa.array(texts[at : at + 50]))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == want[at : at + 50]


def test_plan_is_gapless_and_tight():
    rng = random.Random(4)
    for _ in range(200):
        cap = rng.choice([10, 31, 1024])
        counts = {rng.randint(1, cap): rng.randint(1, 12) for _ in range(rng.randint(0, 30))}
        plan, bins = packing.plan_bins(counts, cap)
        held, made = collections.defaultdict(list), collections.Counter()
        for length, _, first, n, offset in plan.tolist():
            made[length] += n
            for i in range(n):
                held[first + i].append((offset, length))
        assert dict(made) == counts and len(held) == bins
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= cap and sum(3 * length > cap for _, length in own) <= 2
        total = sum(k * v for k, v in counts.items())
        assert bins <= max(1.5 * -(-total // cap) + 1, len(counts))


def test_packing_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "same text here"), (1, "same text here"), (2, None), (3, "")]
    df = spark.createDataFrame([(*r, 9, 9, "k") for r in rows], DOCS + ", piece int, length int, sequence_id string")
    out = packing.pack(df)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = sorted((r.doc_id, r.piece, r.length) for r in out.collect())
    assert [x[:2] for x in got] == [(1, 0), (1, 0), (2, 0), (3, 0)] and got[2][2] == got[3][2] == 1
    assert sorted(r.offset for r in out.collect())[0] == 0 and len({r.sequence_id for r in out.collect()}) == 1


def test_packing_covers_every_token(spark):
    rows = [*corpus(1, 30), (5, "again"), (None, "no id"), (6, "word " * 4000), (7, "中文 " * 900), (8, "a <|endoftext|> b"), (9, "x y " * 60_000)]
    plain = plain_tokenizer()
    out = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0
