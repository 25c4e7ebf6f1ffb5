"""Operators 11 to 13 against brute force, over odd tables, hot groups and every switch of how work is dealt."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, hard_negatives, ngram_jaccard, word_hashes

DOCS = "doc_id long, text string, lang string, source string, h string, comp long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def word_list(text):
    return [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]


def linked(rows, percent=90):
    sets = []
    for _, text in rows:
        w = word_list(lower(text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (key, _) in enumerate(rows):
        if key is not None and (least[root(i)] is None or key < least[root(i)]):
            least[root(i)] = key
    return sorted([(key, len(sets[i]), least[root(i)] if sets[i] else key) for i, (key, _) in enumerate(rows)], key=str)


def corpus(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    texts = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 8, 11, 12, 22, 25, 40, 120]))) for _ in range(n)]
    for _ in range(2 * n):
        w = rng.choice(texts).split(" ") + [word()]
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [w[k], word()]])
        texts.append(" ".join(w))
    return [*enumerate(texts, 5), (3, None), (4, ""), (None, " \t"), (None, texts[0]), (7, texts[1].upper()), (900, "é à ç ñ"), (901, "É à ç ñ"), (902, "x" * 5000 + " y z")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("percent", [80, 90])
def test_components_are_those_of_all_pairs(spark, seed, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(k, t, "l", "s", "x", 1) for k, t in rows], DOCS)
    assert sorted([tuple(r) for r in ngram_jaccard.groups(docs, percent=percent).collect()], key=str) == linked(rows, percent)


def test_large_families_and_both_rounds(spark, monkeypatch):
    """Families far larger than a stretch, all at the edge of the limit, so that round 2 has work."""
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for name, value in (("CHUNK", 16), ("SENT", 3), ("WAITING", 20)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    docs = spark.createDataFrame([(k, t, "l", "s", "x", 1) for k, t in rows], DOCS)
    assert sorted([tuple(r) for r in ngram_jaccard.groups(docs).collect()], key=str) == linked(rows)


@pytest.mark.parametrize("boundary", [0, 12, 25])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, boundary):
    monkeypatch.setattr(ngram_jaccard, "boundary_of", lambda sizes, percent: boundary)
    rows = [r for r in corpus(4, 40) if len((r[1] or "").split()) <= 30]
    docs = spark.createDataFrame([(k, t, "l", "s", "x", 1) for k, t in rows], DOCS)
    assert sorted([tuple(r) for r in ngram_jaccard.groups(docs).collect()], key=str) == linked(rows)


def test_sketches_never_exceed_the_difference_and_cost_decides():
    rng = np.random.default_rng(5)
    for n in (3, 70, 300, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 8).astype(np.uint64)]))
        d = ngram_jaccard._distances([ngram_jaccard._sketch(a).tobytes()], [ngram_jaccard._sketch(b).tobytes()])
        assert d[0, 0] <= len(np.setxor1d(a, b))
    assert ngram_jaccard.boundary_of({5: (100, 1e6)}) >= 5
    assert ngram_jaccard.boundary_of({30: (100, 100.0)}) < 30
    assert ngram_jaccard.subset_sizes(10) == [9, 10]


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    texts = ["a b  c", None, "", "  ", "Foo\tbar\x0b\x0cé foo ", "x" * 100 + " y", "y " * 60, "q"]
    poly = word_hashes.Polynomial(1, True)
    whole = [h.tolist() for h in word_hashes.by_text(pa.array(texts), poly)]
    assert [len(h) for h in whole] == [len(word_list(t)) for t in texts]
    monkeypatch.setattr(word_hashes, "STRETCH", 16)
    assert [h.tolist() for h in word_hashes.by_text(pa.array(texts), poly)] == whole
    assert whole[4][0] == whole[4][-1] and len({x for h in whole for x in h}) == len({lower(w) for t in texts for w in word_list(t)})


def audited(rows, limit, top):
    term = lambda t: [lower(x) for x in divergence.TERM.findall(t or "")]
    rows = [(t, lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == lang]
        held = Counter(x for t, _, _ in mine for x in set(term(t)))
        kept = [x for x, n in held.items() if n >= limit]
        counts = {s: Counter() for _, _, s in mine}
        for t, _, s in mine:
            counts[s].update(x for x in term(t) if held[x] >= limit)
        whole = sum(counts.values(), Counter())
        share = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c.values()) + 5 * len(kept)) for x in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in p:
            pairs = [(-sum(abs(p[s][x] - p[o][x]) for x in kept), o.encode(), o) for o in p if o != s]
            terms = [(q[x] - p[s][x], x.encode(), x) for x in kept if counts[s][x] and p[s][x] > q[x]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", x, -v, k) for k, (v, _, x) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_audit_is_exact(spark, monkeypatch):
    rng = random.Random(7)
    made = lambda: " ".join(rng.choice(["Foo,", "foo", "(foo)", "bar-baz", "été", "a1b", "99", "x'y", "Ünï", f"r{rng.randrange(40)}q"]) + rng.choice(["", ".", "!"]) for _ in range(rng.randrange(0, 30)))
    rows = [(made(), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None])) for _ in range(120)]
    rows += [(None, "xx", "only"), ("", "xx", None), ("alone", "yy", "z"), ("x" * 3000 + ",foo", "en", "s1"), ("foo " * 2000, "en", "s2"), rows[0], rows[0]]
    for name, value in (("HELD", 150), ("TILE", 2), ("TERMS", 4)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(k, t, lang, s, "x", 1) for k, (t, lang, s) in enumerate(rows)], DOCS)
    for limit, top in ((5, 3), (12, 50)):
        assert sorted(map(tuple, divergence.audit(docs, limit, top).collect())) == audited(rows, limit, top)
    monkeypatch.setattr(divergence, "SENT", 0)
    assert sorted(map(tuple, divergence.audit(docs.repartition(3), 5, 3).collect())) == audited(rows, 5, 3)


def mined(rows, step, positives=5, k=10):
    out = []
    for a, label, v in rows:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b, m == label) for b, m, w in rows if b != a and len(w) == len(v))
        for s, b, _ in [x for x in scored if x[2]][:positives]:
            hits = [(n, c) for n, c, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:k]
            out += [(a, b, rank, c, -s, -n) for rank, (n, c) in enumerate(hits, 1)]
    return sorted(out)


def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(9)
    vector = lambda d=6: [rng.choice([-0.5, 0.0, 0.25, 0.3, 0.5, 1.0, 1.5]) for _ in range(d)]
    good = [(k, vector(), rng.choice([0, 0, 0, 1, 2])) for k in range(300)] + [(k, vector(4), 1) for k in range(300, 330)] + [(400, [], 1)]
    bad = [(None, vector(), 1), (500, None, 1), (501, vector(), None), (502, [1.0, None], 1), (503, [float("nan")], 1), (504, [float("inf")], 0)]
    monkeypatch.setattr(hard_negatives, "GROUP", 64)
    monkeypatch.setattr(hard_negatives, "BLOCK", 3)
    df = spark.createDataFrame(good + bad + good[:40], "vec_id long, embedding array<float>, label int")
    rows = hard_negatives.quantised(df)
    whole = [(k, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, v, label in good]
    assert sorted(map(tuple, rows.select("id", "label", "q").collect())) == sorted((k, label, v) for k, label, v in whole)
    assert sorted(map(tuple, hard_negatives.mine(rows, F.col("id") % 10 == 0).collect())) == mined(whole, 10)


def test_scores_are_exact_or_an_error():
    big = np.full((1, 4), 2**30, np.int64)
    assert hard_negatives._scores(big, big)[0, 0] == 4 * 2**60
    with pytest.raises(OverflowError):
        hard_negatives._scores(4 * big, 4 * big)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert ngram_jaccard.groups(docs).count() == 0
    assert divergence.audit(docs).count() == 0
    rows = hard_negatives.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert hard_negatives.mine(rows, F.col("id") % 10 == 0).count() == 0
