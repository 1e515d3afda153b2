"""Operators 11 to 13 against plain loops, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import divergence, impact, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "plain words here", "plain words here", "Ünï Übung ÜBUNG a1 A1", "日本語 text 😀 text", "  \t\n ", "x" * 3000, "a b " * 2000, "co-op, co_op; 12 3 x\x00y", "\x85 a\xa0b  c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "bdfgkÄß" for b in ("a", "ei", "ou", "Um")]
    made = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 60))) for _ in range(300)]
    made += made[:20] + ODD
    return [(None if i % 97 == 5 else i % 310, t, (None, "en", "de", "fr")[i % 4], (None, "s1", "s2")[i % 3], 0) for i, t in enumerate(made)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def terms_of(text):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(upper, upper.lower())))


# op11
def brute_search(rows, items, k=10):
    docs = [(key, Counter(terms_of(text))) for key, text, *_ in rows]
    docs = [(key, c) for key, c in docs if c]
    N, L = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, own in wanted.items():
        scored = []
        for key, c in docs:
            m = 100 - 90 + (90 * c.total() * N) // L
            score = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "ba dei FOU"), (2, "Äa ßei x"), (3, ""), (4, None), (5, "nowhere"), (6, "bà a1 text 日本語"), (7, "ba"), (7, "kUm KUM"), (None, "gou plain"), (8, " ".join(f"{a}{b}" for a in "bdfgk" for b in ("a", "ei", "ou"))), (9, "text"), (10, "co op 12")]


@pytest.mark.parametrize("terms", [1, 1 << 17])
def test_search_equals_plain_loops(spark, rows, docs, monkeypatch, terms):
    monkeypatch.setattr(impact, "QUERY_TERMS", 4 * terms if terms == 1 else terms)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = impact.search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(rows, ITEMS)


def test_search_blocks_add_and_choose_exactly():
    rng = np.random.default_rng(3)
    n_docs, n_terms = 700, 40
    dense = rng.integers(0, 1 << 33, (n_terms, n_docs)) * (rng.random((n_terms, n_docs)) < rng.random((n_terms, 1)))
    dense[5] = dense[5] > 0  # many ties
    term, place = np.nonzero(dense)
    index = impact.Index(term, place, dense[term, place], n_docs, n_terms + 2)
    queries = [np.array([5]), np.arange(n_terms), np.array([], int), np.array([41]), *(rng.permutation(n_terms)[: rng.integers(1, 30)] for _ in range(20))]
    for k in (1, 10, 1000):
        got = {i: [] for i in range(len(queries))}
        for q, at, score in index.search(queries, k):
            for a, b, c in zip(q.tolist(), at.tolist(), score.tolist(), strict=True):
                got[a].append((-c, b))
        for i, q in enumerate(queries):
            own = dense[q[q < n_terms]].sum(axis=0)
            assert sorted(got[i]) == sorted((-int(own[d]), d) for d in np.flatnonzero(own))[:k]


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert impact.search(docs.limit(0), items).count() == 0
    assert impact.search(docs, items.limit(0)).count() == 0
    odd = spark.createDataFrame([("k1", "ba ba", 1, "q"), ("k0", "ba ba", 2, "r"), (None, "ba ba", 3, "s")], "doc_id string, text string, `TEXT` int, query string")
    got = impact.search(odd, spark.createDataFrame([("i", "ba", 4)], "item_id string, text string, `Item_ID` int")).collect()
    assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "k0"), (2, "k1"), (3, None)]


# op12
def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


JUNK = ["WORD!! " * 80, "ab| cd | " * 60, "same " * 100, "one two three four\n" * 40, "a b c a b c a b", "a a a", "a a a a", "é é\n\né é\r\né é\n é é", "#" * 10, "l\n" * 5 + "m \n m"]


def test_quality_counts_equal_plain_loops(spark, rows):
    texts = [r[1] for r in rows] + JUNK
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, `N_WORDS` int")
    got = {r["doc_id"]: r for r in quality.judged(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = brute_counts(text)
        assert tuple(got[i][c] for c in quality.COUNTS[:5]) == want, text
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_quality_pieces_do_not_matter(monkeypatch):
    text = ("à la carte  de jour\n" * 30 + "x y z" * 50).encode()
    want = quality.counts_of(text)
    monkeypatch.setattr("lodestone.llm.terms.PIECE", 7)
    assert quality.counts_of(text) == want
    ids = np.random.default_rng(1).integers(0, 50, 400)
    assert quality.repeated(ids, 50) == quality.repeated(ids, 1 << 22) > 0


def test_quality_em_equals_plain_loops():
    rng = np.random.default_rng(5)
    votes = np.unique(rng.integers(-1, 2, (60, 4)), axis=0)
    counts = rng.integers(1, 500, len(votes))
    model = quality.fit(votes, counts, rounds=7)
    # the same by loops
    m, classes = 4, []
    for v in votes.tolist():
        cast, against = sum(x != 0 for x in v), sum(x < 0 for x in v)
        fine = 1 - against / cast if cast else 0.5
        classes.append([fine] + [(1 - fine) * ((x < 0) / against if against else 1 / m) for x in v])
    total = counts.sum()
    for k in range(8):
        share, chance = [], []
        for c in range(m + 1):
            share.append(sum(n * own[c] for n, own in zip(counts, classes, strict=True)) + total * 1e-6)
            row = []
            for j in range(m):
                prior = quality.PRIOR_FINE if c == 0 else quality.PRIOR_OWN if j == c - 1 else quality.PRIOR_OTHER
                w = total * (quality.WEIGH_FINE if c == 0 else quality.WEIGH_JUNK)
                up = sum(n * own[c] for n, own, v in zip(counts, classes, votes, strict=True) if v[j] > 0)
                cast = sum(n * own[c] for n, own, v in zip(counts, classes, votes, strict=True) if v[j] != 0)
                row.append((up + prior * w) / (cast + w))
            chance.append(row)
        share = [s / sum(share) for s in share]
        if k < 7:
            for i, v in enumerate(votes.tolist()):
                own = [share[c] * math.prod(chance[c][j] if x > 0 else 1 - chance[c][j] if x < 0 else 1 for j, x in enumerate(v)) for c in range(m + 1)]
                classes[i] = [x / sum(own) for x in own]
    assert np.allclose(model.share, share) and np.allclose(model.chance, chance)
    assert ((0 <= model.accuracy()) & (model.accuracy() <= 1)).all()


def test_quality_tells_junk_from_prose_without_labels(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("", "n", "st", "ling")]
    prose = [" ".join(rng.choice(words) + ("." if i % 9 == 8 else "") for i in range(rng.randint(60, 200))) for _ in range(400)]
    junk = [[p.upper().replace(" ", "!! "), p.replace(" ", "$$$ "), p.replace(" ", " | "), p[:80] + (" " + p[:80]) * 9][i % 4] for i, p in enumerate(prose[:48])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(prose[48:] + junk)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(df).collect()}
    assert all(kept[i] for i in range(352)) and not any(kept[i] for i in range(352, 400))
    out = quality.cleaned(df.withColumnRenamed("doc_id", "DOC_ID"))
    assert out.columns == ["DOC_ID", "text"] and {r[0] for r in out.collect()} == set(range(352))


def test_quality_of_nothing(spark, docs):
    assert quality.judged(docs.limit(0)).count() == 0 and quality.cleaned(docs.limit(0)).count() == 0


# op13
def brute_audit(rows):
    letters = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    groups, df = {}, {}
    for _, text, lang, source, *_ in rows:
        own = Counter(re.findall(letters, (text or "").translate(str.maketrans(upper, upper.lower()))))
        groups.setdefault((lang or "", source or ""), Counter()).update(own)
        df.setdefault(lang or "", Counter()).update(own.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in df[lang].items() if n >= 3), key=lambda t: t.encode())
        counts = {s: [c[t] for t in kept] for (g, s), c in groups.items() if g == lang}
        whole = [sum(x) for x in zip(*counts.values(), strict=True)]
        p = lambda c: [1 + (10**9 * (n + 1)) // (sum(c) + len(kept)) for n in c]
        f = lambda a, b: [(x - y) * (x - y) // y for x, y in zip(a, b, strict=True)]
        for source, c in counts.items():
            pairs = [(sum(f(p(c), p(other))), s) for s, other in counts.items() if s != source]
            terms = [(v, t) for v, t, n, x, y in zip(f(p(c), p(whole)), kept, c, p(c), p(whole), strict=True) if n > 0 and x > y]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, t, v, i) for i, (v, t) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("side,limit,cells", [(128, 50_000, 1 << 19), (1, 1, 4)])
def test_audit_equals_plain_loops(spark, rows, docs, monkeypatch, side, limit, cells):
    for name, value in (("SIDE", side), ("LIMIT", limit), ("CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows)


def test_audit_odd_tables(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    few = [(1, None, "aa", "x", 0), (2, "only once", "aa", None, 0), (3, "w w w", "bb", "x", 0), (4, "lone", "cc", "x", 0)] + [(5, "same", "dd", s, 0) for s in ("x", "y", "x")]
    odd = spark.createDataFrame([(*r, "n") for r in few], DOCS + ", term string").toDF("doc_id", "text", "lang", "source", "SOURCE", "term")
    assert sorted(map(tuple, divergence.audit(odd).collect())) == brute_audit(few)


def test_shares_are_exact():
    rng = np.random.default_rng(9)
    size = rng.integers(1, 1 << 55, 500)
    count = (size * rng.random(500)).astype(np.int64)
    assert divergence.share(count, size).tolist() == [1 + (10**9 * (int(c) + 1)) // int(s) for c, s in zip(count, size, strict=True)]
