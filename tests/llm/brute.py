"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import re

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def substring(rows, size):
    """[(id, words, removed, digest)] in the order of rows."""
    words = [SPACED.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for a in range(len(w) - size + 1) if count[tuple(w[a : a + size])] > 1 for k in range(a, a + size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def contamination(rows, items, size=10):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w and i is not None else 0):
            windows[tuple(w[k : k + n])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = plain_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if own := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def near_duplicates(rows, threshold=0.8, size=5):
    """{id: smallest id of its class}."""
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = collections.Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else collections.Counter()
    union = Union()
    ids = list(sets)
    for a in ids:
        union.find(a)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            common, total = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if total and common >= threshold * total - 1e-12:
                union.join(a, b)
    return {i: union.find(i) for i in ids}


def phrases(rows, longest=4):
    """({(lang, phrase): occurrences}, {lang: words}) of rows (lang, text)."""
    count, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                count.update((lang, " ".join(w[i : i + n])) for i in range(len(w) - n + 1))
    return count, total


def collocations(rows, threshold=30, top=2000, redundant=80):
    """[(lang, rank, phrase, a, l, r, n, score)]."""
    count, total = phrases(rows)
    found = {k: a for k, a in count.items() if a >= threshold}
    around = collections.Counter()
    for (lang, p), a in found.items():
        w = p.split(" ")
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                k = (lang, " ".join(w[i : i + n]))
                around[k] = max(around[k], a)
    by_lang = collections.defaultdict(list)
    for (lang, p), a in found.items():
        w = p.split(" ")
        if len(w) > 1 and 100 * around[lang, p] < redundant * a:
            cuts = [(found[lang, " ".join(w[:k])], found[lang, " ".join(w[k:])], k) for k in range(1, len(w))]
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
            by_lang[lang].append((-score, -a, p.encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, own in by_lang.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top])]


def divergence(rows, least=30, top=50):
    """[(lang, source, part, item, value, rank)] of rows (lang, source, text)."""
    held, count, documents = collections.defaultdict(collections.Counter), collections.Counter(), collections.Counter()
    groups = set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups.add((lang, source))
        held[lang, source].update(words)
        documents.update((lang, w) for w in set(words))
    share = lambda n, total, v: 1 + 1_000_000_000 * (n + 5) // (total + 5 * v)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in documents.items() if x == lang and n >= least)
        own = sorted(s for x, s in groups if x == lang)
        p = {}
        for s in own:
            total = sum(held[lang, s][w] for w in kept)
            p[s] = {w: share(held[lang, s][w], total, len(kept)) for w in kept}
        count = {w: sum(held[lang, s][w] for s in own) for w in kept}
        q = {w: share(count[w], sum(count.values()), len(kept)) for w in kept}
        for s in own:
            pairs = [(sum(abs(p[s][w] - p[t][w]) for w in kept), t) for t in own if t != s]
            terms = [(p[s][w] - q[w], w) for w in kept if held[lang, s][w] and p[s][w] > q[w]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])]
    return out
