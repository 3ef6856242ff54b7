"""SQL of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{PLAIN}')"


OP2 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 34, 0))) AS i FROM d),
h AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM p),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM d),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (doc_id, j) GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP8 = f"""WITH d AS (SELECT doc_id, {plain('text')} AS w FROM documents),
b AS (SELECT item_id, {plain('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM m),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS k FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM bw)),
hits AS (SELECT di.doc_id, di.n, i, item_id FROM di JOIN bw ON bw.n = di.n AND bw.k = array_to_string(w[i + 1 : i + di.n], ' ')),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP10 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM m"""

_REACH = """reach(n, c) AS (SELECT a, a FROM link UNION SELECT b, b FROM link UNION SELECT CASE WHEN l.a = r.n THEN l.b ELSE l.a END, r.c FROM reach r JOIN link l ON (l.a = r.n OR l.b = r.n) AND r.c < CASE WHEN l.a = r.n THEN l.b ELSE l.a END),
low AS (SELECT n, min(c) AS c FROM reach GROUP BY n)"""

OP5 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH}, n AS (SELECT k, count(*) AS links FROM (SELECT a AS k FROM link UNION ALL SELECT b FROM link) GROUP BY k)
SELECT vec_id, coalesce(links, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON k = vec_id LEFT JOIN low ON low.n = vec_id"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {plain('text')} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS k, count(*) AS n FROM p GROUP BY ALL), z AS (SELECT doc_id, sum(n) AS z FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM o JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE common >= 0.8 * (za.z + zb.z - common) - 1e-9),
{_REACH}
SELECT d.doc_id, coalesce(c, d.doc_id) AS component_id, CASE WHEN len(w) = 0 THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY w) END AS copy_of, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN low ON low.n = d.doc_id"""

LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERS}') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d), kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, coalesce(v, 0)::HUGEINT AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total FROM g LEFT JOIN v USING (lang)),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * gn.v) AS p FROM gn JOIN kept k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
lt AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL), ln AS (SELECT lang, sum(n)::HUGEINT AS total FROM lt GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (lt.n + 5)) // (total + 5 * v.v) AS q FROM lt JOIN ln USING (lang) JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

OP12 = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
o AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM w, (SELECT unnest(range(1, 5)) AS k))),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inn AS (SELECT lang, a, array_to_string(w[i + 1 : i + s], ' ') AS phrase FROM (SELECT lang, a, w, s, unnest(range(0, k - s + 1)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2))),
m AS (SELECT lang, phrase, max(a) AS around FROM inn GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, (2000000 * a) // (x.f + y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r.r::BIGINT AS r, n, score::BIGINT AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000"""

SQL = {"op11_source_divergence": OP11, "op12_collocations": OP12, "op2_substring_dedup": OP2, "op5_embedding_dedup": OP5, "op8_decontaminate": OP8, "op9_minhash": OP9, "op10_warc": OP10}
