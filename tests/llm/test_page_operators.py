import collections
import hashlib
import math
import os
import re
import time
import uuid
import zlib

import numpy as np
import pytest
from brute import Union

from tidebar.llm import embedding_dedup, page_text, sharding, url_filter, warc
from tidebar.llm.common import scratch

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("https://Blog.Example.COM/en/1?x=/y", "blog.example.com", "/en/1", "example.com/en/", "block"),
        ("http://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://example.com/de/1#f", "example.com", "/de/1", "com/", "allow"),
        ("http://x.net/fr/1", "x.net", "/fr/1", "net/fr/", "block"),
        ("http://notexample.com?q", "notexample.com", "", None, None),
        ("http://internet/fr/", "internet", "/fr/", None, None),
        ("no scheme.com/", "", "", None, None),
        (None, "", "", None, None),
        ("x://", "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    row = url_filter.ruled(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (row.host, row.path, row.rule, row.by_rule) == (host, path, rule, verdict)


def test_url_models_follow_their_urls(spark):
    rows = [(i, f"http://shop{i % 7}.com/good/news/{i}") for i in range(300)] + [(1000 + i, f"http://w{i % 5}.net/fr/pills-cheap-{i}") for i in range(300)]
    tests = [(5000, "http://a.org/good/news/77"), (5001, "http://b.org/fr/pills-cheap-9"), (5002, None), (5003, "")]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows + tests, "page_id long, url string")).collect()}
    assert out[5000].verdict == "allow" and out[5001].verdict == "block" and out[5002].verdict in ("allow", "block")
    assert len(out) == 604 and all(r.verdict == "allow" for i, r in out.items() if i < 300)
    none = url_filter.judge(spark.createDataFrame(tests, "page_id long, url string")).collect()
    assert all(r.verdict == "allow" and r.rule is None for r in none)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def url_differences(taught, asked):
    """The two models, plainly: counts of every context, for each side."""
    seen = [collections.Counter(), collections.Counter()]
    steps = lambda u: [("\0" * 5 + u)[i : i + 6] for i in range(len(u))]
    lower = lambda u: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in u)
    for url, good in taught:
        for step in steps(lower(url)):
            for k in range(6):
                seen[good]["context", step[5 - k : 5]] += 1
                seen[good]["next", step[5 - k :]] += 1
    out = {}
    for url in asked:
        total = 0.0
        for step in steps(lower(url)):
            for side, sign in ((1, 1), (0, -1)):
                p = 1 / url_filter.ALPHABET
                for k in range(6):
                    n = seen[side]["context", step[5 - k : 5]]
                    p = (seen[side]["next", step[5 - k :]] + url_filter.SMOOTHING * p) / (n + url_filter.SMOOTHING) if n >= url_filter.SEEN else p
                total += sign * math.log(p)
        out[url] = total / max(len(url), 1)
    return out


@pytest.mark.parametrize("hot", [0, 7, 100_000])
def test_url_models_against_a_plain_version(spark, hot):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcXyz/-%"), rng.integers(1, 9)))
    taught = [(f"http://{word()}.com/{word()}", 1) for _ in range(150)] + [(f"http://w.net/fr/{word()}-{word()}", 0) for _ in range(90)]
    asked = [f"ftp://{word()}.org/{word()}" for _ in range(60)] + ["", "x", "y" * 30_000]
    counts = url_filter.models(spark.createDataFrame([(u, bool(g)) for u, g in taught], "url string, good boolean"))
    got = {r.url: r.difference for r in url_filter.differences(counts, spark.createDataFrame([(u,) for u in asked], "url string").distinct(), hot).collect()}
    want = url_differences(taught, asked)
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want)


def test_url_filter_with_clashing_columns_and_repeated_rows(spark):
    rows = [(i % 50, f"http://a{i % 9}.com/x{i % 25}", "k", 1) for i in range(200)] + [(i, f"http://b.net/es/y{i % 30}", "k", 2) for i in range(100)] + [(7, "http://c.org/x" + "long" * 20_000, "k", 3)] * 3
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string, difference int"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict", "difference"] and out.count() == len(rows)
    assert len(set(out.filter("host = 'c.org'").collect())) == 1


TEMPLATE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><a href="/x">Menu</a></nav>
<div class="ad">Buy</div>%s<footer>&copy; Foot</footer></body></html>"""


def texts(spark, rows):
    return {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_article_is_the_main_text(spark):
    page = TEMPLATE % "<article><h1>Head &amp; line</h1><p><b>One<br><p>two\n  &eacute;&nbsp;x</p><!-- no --><aside>side</aside><div class='comments'><p>hi</p></div></article>"
    got = texts(spark, [(1, "http://a.com/1", page), (2, "http://a.com/2", None), (3, None, ""), (4, "http://b.com/", "plain a &lt; b")])
    assert got == {1: "Head & line One two é x", 2: "", 3: "", 4: "plain a < b"}


def test_lines_shared_with_the_nearest_page_go(spark):
    body = "<div>Site name</div><p>%s</p><div>Please subscribe</div>"
    rows = [(i, f"http://a.com/{i}", f"<html><body>{body % f'Text {i}'}</body></html>") for i in range(1, 5)] + [(9, "http://z.com/", "<body><p>Alone</p></body>")]
    assert texts(spark, rows) == {**{i: f"Text {i}" for i in range(1, 5)}, 9: "Alone"}


@pytest.mark.parametrize(
    "body, text",
    [
        ("<article><p class='notice'>Cookie<p>Real one<p>Real two</article>", "Real one Real two"),
        ("<article><ul><li class='ad'>x<li>kept<li>also</ul><table><tr><td class=share>s<td>cell</table></article>", "kept also cell"),
        ("<article><div class='entry-header'><h1>Headline</h1></div><h1 class='article-header'>More</h1><p>x</article>", "Headline More x"),
        ("<article><p>Please <span class='alert'>stop</span> here</p></article>", "Please stop here"),
        ("<article><dl><dt>a<dd class=promo>b<dt>c<dd>d</dl></article>", "a c d"),
        ("<article><div class=sidebar><p>a</div><p>b</article>", "b"),
        ("<header>Site</header><article><header>Head</header><p>x</p></article>", "Head x"),
        ("<div class=comments><p>one<div>two</div></div><p>text</p>", "text"),
        ("<p>a</div></ul></li>b &lt;p&gt; \u00a0 c", "a b <p> c"),
        ("<p>a<!-- <p>no --> b<script>if (a<b) '</p>'</script>c<style>p{}", "a b c"),
    ],
)
def test_elements(body, text):
    assert page_text.main_text(page_text.lines(body), None) == text


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    assert page_text.lines("<div>" * 60_000 + "x" + "</p>" * 60_000 + "</div>" * 60_000)[0] == [("x", False, False)]
    assert len(page_text.lines("<p>some line of text " * 60_000)[0]) == 60_000
    assert time.time() - began < 20


def site(n=400):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        host = "big.com" if i % 3 == 0 else f"h{i % 7}.org"
        path = "/" + "/".join(rng.choice(["a", "b", "news", "x1"], rng.integers(0, 4)).tolist()) + (f"/{i}" if i % 5 else "")
        lines = [*rng.choice([f"menu {k}" for k in range(9)], 5).tolist(), f"Text {i} of {host}", *rng.choice([f"foot {k}" for k in range(5)], 3).tolist()]
        rows.append((i, f"http://{host}{path}?q", "".join(f"<p>{x}" for x in lines), "z"))
    rows += [(1000, None, "<p>no host"), (1001, "nothing", "<p>no host<p>own"), (1002, "http://lone.net/", "<p>Alone"), (1003, "http://big.com/", None), (None, "http://h1.org/a", "<p>menu 1<p>no id")]
    return [(*r[:3], "z") for r in rows]


def differenced(rows):
    """Every page with the nearer page of its host, plainly."""
    hosts = collections.defaultdict(list)
    for i, url, page, _ in rows:
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        hosts[host.lower()].append((re.match(r"[^?#]*", rest[len(host) :])[0].encode(), i is not None, i or 0, page_text.lines(page or "")))
    start = lambda a, b: len(os.path.commonprefix([a.decode(), b.decode()]))
    out = collections.Counter()
    for own in hosts.values():
        own.sort(key=lambda x: x[:3])
        for at, (path, known, i, page) in enumerate(own):
            near = [own[k] for k in (at - 1, at + 1) if 0 <= k < len(own)]
            mate = max(near, key=lambda x: start(x[0], path))[3] if near else None
            out[i if known else None, page_text.main_text(page, mate)] += 1
    return out


@pytest.mark.parametrize("partitions", [1, 4, 61])
def test_neighbours_do_not_depend_on_partitions(spark, partitions):
    rows, before = site(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = page_text.extract(spark.createDataFrame(rows, PAGES + ", text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert collections.Counter((r.page_id, r.text) for r in out) == differenced(rows)
    assert all(r.n_chars == len(r.text) for r in out) and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}


def test_repeated_pages_and_empty_tables(spark):
    rows = [(1, "http://a.com/1", "<p>same<p>x")] * 9 + [(2, "http://a.com/1", "<article><p>kept</p></article>")] * 2
    out = page_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert collections.Counter((r.page_id, r.text) for r in out) == {(1, ""): 9, (2, "kept"): 2}
    assert page_text.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_common_subsequence():
    assert page_text.shared(list("abcxd"), list("abyd")) == {0, 1, 4}
    assert page_text.shared(list("xaybzc"), list("a1b2c")) == {1, 3, 5}
    assert page_text.shared([], ["a"]) == set()


def test_warc_round_trip(spark):
    big, small = "<p>" + "é long page " * 200, "<p>tiny"
    rows = [(1, "http://a/\n1", big), (2, None, big), (7, "http://a/7", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (7, "http://a/7", big), (8, "u", "x" * 1000), (9, "u", "x" * 1000), (10, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], PAGES + ", record_type string").repartition(3)
    archives = warc.write_archives(df, archive_bytes=2000)
    assert archives.count() > 1
    by = collections.defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    want = []
    for i, _, h in rows:
        raw, top = (h or "").encode(), max(by[h or ""])
        again = len(raw) >= 1000 and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else 0))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.read_archives(archives).collect()) == sorted(want)
    for a in archives.collect():
        content = bytes(a.content)
        assert int.from_bytes(content[:4], "little") == warc.MAGIC
        found = [warc.parse_record(r) for r in warc.read_archive(content)]
        assert len(found) == a.records and all(not f["payload"] for f in found if f["record_type"] == "revisit")
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGES))).count() == 0


def test_warc_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{'text ' * i}") for i in range(60)], PAGES)
    assert warc.export(warc.write_archives(df), str(tmp_path)) == len(list(tmp_path.glob("*.warc.zst"))) > 0
    payloads = {r["page_id"]: r["payload"] for f in tmp_path.glob("*.warc.zst") for r in map(warc.parse_record, warc.read_archive(f.read_bytes()))}
    assert payloads == {i: f"<p>{'text ' * i}".encode() for i in range(60)}


def test_an_archive_is_read_in_one_pass():
    import zstandard

    rng = np.random.default_rng(1)
    for checksum in (False, True):
        packer = zstandard.ZstdCompressor(write_checksum=checksum)
        records = [b"", b"a", b"z" * 700_000, rng.bytes(300_000), *[b"page %d" % i * (i % 50) for i in range(3000)]]
        frames = [packer.compress(r) for r in records]
        assert [warc.frame_size(memoryview(f + b"more" * 9)) for f in frames] == list(map(len, frames))
        archive = warc.dictionary_frame(b"") + b"".join(frames)
        assert list(warc.read_archive(archive)) == records
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(archive[:-3]))


def test_embeddings_with_repeated_ids_and_clashing_columns(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [0.0, 1.0]]
    rows = [(1, v[0], 1, "k", 5), (1, v[2], 1, "k", 5), (2, v[1], 1, "k", 5), (3, v[3], 1, "k", 5), (None, v[0], 1, "k", 5), (4, v[0], None, "k", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, leaf string, links int")
    out = embedding_dedup.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted((r.vec_id or 0, r.component_id or 0, r.kept) for r in out.collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_dictionary_makes_small_records_smaller():
    pages = [f"<html><head><title>{i}</title></head><body><article><p>words {i * 7} and more words</p></article></body></html>".encode() for i in range(400)]
    import zstandard

    size = lambda d: sum(len(zstandard.ZstdCompressor(dict_data=d).compress(p)) for p in pages)
    assert size(zstandard.ZstdCompressionDict(warc.train_dictionary(pages))) < 0.7 * size(None)


def test_shards_against_a_plain_version(spark):
    rows = [(i, "xé" * (i * 37 % 450), i) for i in range(3000)] + [(5, "dup", 1), (5, "dup", 1), (None, None, 2), (-1, "", 3), (None, "long " * 50_000, 4)] + [(None, f"null {i}", 0) for i in range(300)]
    df, path = spark.createDataFrame(rows, "doc_id long, text string, size int"), f"{scratch(spark)}/slot-map-{uuid.uuid4().hex}"
    out = sharding.shard(df, path).collect()
    load, places = collections.Counter(), collections.defaultdict(list)
    for r in out:
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    facts = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter(facts(i, t) for i, t, _ in rows)
    # one record is larger than a shard's share; the others are near equal
    rest = sorted(load.values())[:-1]
    assert len(load) == 24 and rest[-1] - rest[0] <= 16
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    version, owner = sharding.load_map(spark, path)
    assert version == 2 and all(r.shard == owner[r.virtual_slot] and r.map_version == 2 for r in out)
    assert len({r.virtual_slot for r in out if r.doc_id is None}) > 200 and len({r.virtual_slot for r in out if r.doc_id == 5}) == 1
    assert sharding.load_map(spark, path, 1)[1] == sharding.first_map(24)
    # the next version leaves alone what need not move
    again = sharding.shard(df.filter("doc_id is not null"), path)
    moved = {r.doc_id: (r.shard, r.map_version) for r in again.collect()}
    assert {v for _, v in moved.values()} == {3} and sum(moved[r.doc_id][0] != r.shard for r in out if r.doc_id is not None) < 400
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), path + "-empty").count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, path, slots=64)


def test_growing_moves_slots_only_to_the_new_shard():
    weight = {s: 1 + s * 7919 % 1000 for s in range(4096)}
    owner = sharding.rebalance(sharding.first_map(24), weight, 24)
    grown = sharding.grow(owner, weight, 24)
    assert all(a == b or b == 24 for a, b in zip(owner, grown))
    load = collections.Counter()
    for s, shard in enumerate(grown):
        load[shard] += weight[s]
    assert max(load.values()) < 1.02 * sum(load.values()) / 25
    still = sharding.rebalance(owner, weight, 24)
    assert sum(a != b for a, b in zip(owner, still)) < 50


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((40, 16))
    vectors = [(centre[i % 40] + 0.06 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(900)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(2000 + i, (centre[0] * 3).tolist(), 0) for i in range(30)] + [(3000, vectors[0], None), (3001, None, 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [None] * 16, 1), (3005, [float("inf")] * 16, 1), (3006, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf=64).collect()}
    good = [(i, np.array(v, np.float64), g) for i, v, g in rows if i < 3000]
    links, union = collections.Counter(), Union()
    for g in range(3):
        own = [(i, v / np.linalg.norm(v)) for i, v, k in good if k == g]
        m = np.array([np.asarray(v, np.float32).astype(np.float64) for i, v, k in good if k == g])
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1))):
            links[own[a][0]] += 1
            links[own[b][0]] += 1
            union.join(own[a][0], own[b][0])
    assert sum(r.n_links for r in out.values()) >= 0.99 * sum(links.values()) > 0
    assert all(r.n_links <= links[i] for i, r in out.items())
    wrong = sum(r.component_id != union.find(i) for i, r in out.items())
    assert wrong <= 2 and len(out) == len(rows) and all(out[i].n_links == 0 and out[i].kept for i in range(3000, 3007))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_overfull_leaves_are_split_until_small(spark, monkeypatch):
    """A sample far smaller than the table, and one label with nearly all rows: leaves end small, and links are found as before."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 24))
    vectors = (base[rng.integers(0, 1500, 4000)] + 0.03 * rng.standard_normal((4000, 24))).astype(np.float32)
    rows = [(i, v.tolist(), 1 if i % 50 else 2, "k", 0) for i, v in enumerate(vectors)] + [(9000 + i, [1.0] * 24, 3, "k", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, mate string, n_links int")
    sizes = []
    compare = embedding_dedup._refined

    def refined(*a):
        out = compare(*a)
        sizes.append(out.selectExpr("label", "explode(leaves) leaf").groupBy("label", "leaf").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(embedding_dedup, "_refined", refined)
    monkeypatch.setattr(embedding_dedup, "LEAF_SAMPLE", 200)
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, leaf=100, sample_rows=150, overfull=400).collect()}
    assert sizes[0] <= 400 and len(out) == len(rows)
    links, union = collections.Counter(), Union()
    for label in (1, 2):
        own = [i for i, _, g, *_ in rows if g == label]
        m = vectors[own].astype(np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= 0.98, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            union.join(own[a], own[b])
    found = sum(out[i].n_links for i in range(4000))
    assert sum(links.values()) >= found >= 0.97 * sum(links.values()) > 4000
    assert all(out[i].n_links <= links[i] for i in range(4000)) and all(out[9000 + i].n_links == 299 for i in range(300))
    assert sum(out[i].component_id != union.find(i) for i in range(4000)) <= 40


@pytest.mark.parametrize("rows", [4, 1400])
def test_embedding_chains_are_one_component(spark, rows):
    """A path whose inner link is nobody's link to its smallest neighbour, in one block and over several chunks; other lengths link too."""
    order = [1, 3, 4, 2] if rows == 4 else np.random.default_rng(2).permutation(rows).tolist()
    step = 11 if rows == 4 else 360 / (2 * rows)
    turn = np.deg2rad(np.arange(rows) * step)
    data = [(int(i), [float(np.cos(t)), float(np.sin(t))], 0) for i, t in zip(order, turn)]
    data += [(10_000 + i, [float(np.cos(t)), float(np.sin(t)), 0.0], 0) for i, t in zip([1, 3, 4, 2], np.deg2rad([0, 11, 22, 33]))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    near = 11.2 if rows == 4 else 0.2
    out = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, threshold=float(np.cos(np.deg2rad(near)))).collect()}
    if rows == 4:
        assert {i: out[10_000 + i].component_id for i in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), 10_001)
        assert [out[10_000 + i].n_links for i in (1, 3, 4, 2)] == [1, 2, 2, 1]
    assert {out[int(i)].component_id for i in order} == {min(order)}
    assert [out[int(i)].n_links for i in order] == [1] + [2] * (rows - 2) + [1]
    assert sum(out[int(i)].kept for i in order) == 1


def test_long_pages_lose_only_lines_that_an_alignment_shares():
    a, b = [f"a{i}" for i in range(2100)], [f"b{i}" for i in range(2100)]
    # a is before b on one page and after it on the other: one of them is shared, not both
    taken = page_text.shared(["x", *a, *b, "q"], ["y", *b, *a, "r"])
    assert len(taken) == 2100


def test_alignments_are_longest():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(0, 90)).astype(str).tolist() for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        taken = page_text.shared(a, b)
        assert len(taken) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in sorted(taken))
