"""SimHash groups, repeated-string removal, decontamination, the classifier and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import cgk_decontam, components, pfp_dedup, registry, rule_ensemble, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (None, "one", None), (3, base, "y"), (3, base, "y"), (4, base.upper(), "z"), (5, base + " w60", None), (6, "x" * 20000, "q"), (7, "\t \n", "q")]
    return spark.createDataFrame(rows, SCHEMA)


def finger(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(keys, linked):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_simhash_groups(docs, odd):
    for df in (docs, odd.where("doc_id IS NOT NULL")):
        rows = [(r["doc_id"], finger(r["text"])) for r in df.collect()]
        fps = sorted({f for _, f in rows})
        by = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4])
        least = collections.defaultdict(list)
        for k, f in rows:
            least[by[f]].append(k)
        want = collections.Counter((k, f"{f:016x}", min(least[by[f]])) for k, f in rows)
        got = simhash.groups(df).select("doc_id", simhash.as_hex("fp").alias("h"), "component_id").collect()
        assert collections.Counter(map(tuple, got)) == want
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.groups(odd).where("doc_id IS NULL").count() == 1


def test_gray_index_loses_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for b in base]]))
    a = fp[np.argsort(simhash.gray_rank(fp))]
    i, j = simhash.links(a, a, 4)
    assert len(i) == int((np.bitwise_count(a[:, None] ^ a[None, :]) <= 4).sum())


def test_near_pairs_with_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 16)
    rng = random.Random(5)
    fps = {sum(1 << k for k in rng.sample(range(63), 3)) for _ in range(150)} | {rng.getrandbits(62) for _ in range(50)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.connected(simhash.near_pairs(df)).collect()}
    want = roots(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    assert {f: got.get(f, f) for f in fps} == want


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.connected(df.limit(0)).count() == 0


def test_long_components_and_hubs(spark):
    hub = [(0, k) for k in range(1, 600)] + [(1000 + k, 2000) for k in range(400)] + [(2000, 5000)] + [(9000 + k, 9001 + k) for k in range(60)]
    df = spark.createDataFrame(hub, "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(df).collect()}
    nodes = {x for e in hub for x in e}
    assert got == roots(sorted(nodes), hub)
    with pytest.raises(RuntimeError):
        components.connected(df, rounds=1)


def test_blocks_lose_no_link(spark):
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**11, 10**14)] == [5, 5, 6, 7, 8]
    rng = random.Random(9)
    fps = {sum(1 << k for k in rng.sample(range(63), 3)) for _ in range(100)} | {rng.getrandbits(62) for _ in range(30)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = roots(sorted(fps), [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for blocks in (5, 6, 8):
        got = {r["node"]: r["root"] for r in components.connected(simhash.near_pairs(df, 4, blocks)).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def test_keep_one(spark, docs, odd):
    kept = simhash.keep_one(docs)
    want = {r["component_id"] for r in simhash.groups(docs).collect()}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    base = " ".join(f"w{k}" for k in range(60))
    clash = [(5, base, "head"), (5, "quite another text of few words", "alone"), (8, base.upper(), "copy"), (None, base, "copy"), (None, "only here, without an id at all", "null"), (9, None, "empty"), (9, "", "empty")]
    for df in (odd, spark.createDataFrame(clash, SCHEMA)):
        rows = df.collect()
        by = collections.defaultdict(list)
        fps = sorted({finger(r["text"]) for r in rows})
        near = roots(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4])
        for r in rows:
            by[near[finger(r["text"])]].append((r["doc_id"] is None, r["doc_id"] or 0))
        got = [(r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.keep_one(df).collect()]
        assert sorted(got) == sorted(min(v) for v in by.values())
    assert simhash.keep_one(odd.limit(0)).count() == 0
    assert {r["fp"] for r in simhash.keep_one(spark.createDataFrame(clash, SCHEMA)).collect()} == {"head", "alone", "null", "empty"}


def removed(rows, length):
    seen, out = set(), []
    for key, raw in rows:
        cover = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            h = raw[s : s + length]
            if h in seen:
                cover[s : s + length] = b"\1" * length
            seen.add(h)
        runs = sum(1 for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1]))
        out.append((key, len(raw), sum(cover), runs, hashlib.sha256(bytes(x for x, c in zip(raw, cover) if not c)).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    made = df.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h"))
    return sorted((tuple(r) for r in made.collect()), key=str)


@pytest.mark.parametrize("length, few", [(12, 64), (12, 3), (100, 64), (100, 1)])
def test_repeated_strings(spark, docs, length, few, monkeypatch):
    monkeypatch.setattr(pfp_dedup, "FEW", few)
    rng = random.Random(length)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(5, 300))) for _ in range(30)]
    made = [(k, "".join(rng.choices(pool, k=rng.randint(0, 4))) + "é" * rng.randint(0, 130)) for k in range(60)] + [(100, None), (101, ""), (102, "ab" * 900)]
    for rows in (made, [tuple(r) for r in docs.limit(60).collect()]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert shown(pfp_dedup.dedup(df, length=length)) == removed([(k, (t or "").encode()) for k, t in sorted(rows)], length)


@pytest.mark.parametrize("length, few", [(12, 64), (12, 2), (100, 64), (100, 1)])
def test_repeated_strings_with_one_trigger_in_all_documents(spark, length, few, monkeypatch):
    """A short passage that every document holds, amid text of its own: one trigger of as many phrases as documents."""
    for name, value in (("FEW", few), ("HINT", 1), ("HOT_LEAST", 5), ("SALTS", 7)):
        monkeypatch.setattr(pfp_dedup, name, value)
    rng = random.Random(length + few)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(max(8, length - 20))
    rows = [(k, noise(rng.randint(0, 150)) + passage + (passage if k % 5 == 0 else "") + noise(rng.randint(0, 150)) + ("tail" * 40 if k % 7 == 0 else "")) for k in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    numbered, _ = pfp_dedup._numbered(df, "doc_id", "text")
    assert length == 12 or pfp_dedup._hot_triggers(numbered, length).count() > 0
    assert shown(pfp_dedup.dedup(df, length=length)) == removed([(k, t.encode()) for k, t in rows], length)


def test_repeated_strings_odd_ids(spark, odd):
    out = shown(pfp_dedup.dedup(odd))
    assert len(out) == odd.count()
    twin = [r for r in out if r[0] == 3]
    assert twin[0] == twin[1]  # same id and text: one document
    assert pfp_dedup.dedup(odd.limit(0)).count() == 0


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.insert(k, "zzz"), lambda: out.pop(k), lambda: out.__setitem__(k, "yyy")])()
    return out


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"].split() for r in bench.collect()}
    rng, noise = random.Random(2), [w for r in docs.limit(20).collect() for w in r["text"].split()]
    rows, want = [], {}
    for k in range(300):
        i = rng.choice(sorted(items))
        n = rng.randint(0, int(0.18 * len(items[i])))
        rows.append((k, " ".join(rng.choices(noise, k=40) + edited(rng, items[i], n) + rng.choices(noise, k=40))))
        want[k] = i
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in cgk_decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert sum((k, i) in got for k, i in want.items()) >= 0.95 * len(want)
    # Whatever is reported is right: the distance is that of the nearest stretch.
    for (k, i), d in list(got.items())[:40]:
        a, b = (np.array([hash(w.lower()) for w in x]) for x in (items[i], dict(rows)[k].split()))
        assert cgk_decontam.best_stretch(a, b)[0] == d <= 0.2 * len(a)


@pytest.mark.parametrize("size", [5, 16, 17, 20, 21, 24, 28, 40, 59])
def test_decontamination_at_full_damage(size):
    """Every passage with exactly the allowed edits is found: edits at the head, evenly spaced and anywhere."""
    rng, slack = random.Random(size), size // 5
    names = [[f"i{k}w{j}" if j % 3 else f"c{j}" for j in range(size)] for k in range(6)]
    ready = cgk_decontam.Items([(k, " ".join(x)) for k, x in enumerate(names)], cgk_decontam.Plan())
    texts, want = [], set()
    for k in range(120):
        passage = list(names[k % 6])
        at = range(slack) if k % 3 == 0 else [(j * size + size // 2) // slack for j in range(slack)] if k % 3 == 1 else sorted(rng.sample(range(size), slack))
        for j in sorted(at, reverse=True):
            passage[j : j + 1] = [[f"x{j}"], [], [f"x{j}", passage[j]]][0 if k % 3 < 2 else rng.randrange(3)]
        texts.append(" ".join([f"n{j}" for j in range(30)] + passage + [f"m{j}" for j in range(30)]))
        want.add((k, k % 6))
    got = {(n, i): d for n, i, d, _ in cgk_decontam.matches(ready, texts, cgk_decontam.LEAST)}
    assert want == set(got) and max(got.values()) <= slack


@pytest.mark.parametrize("size", [17, 18, 19, 20, 21, 24, 28, 29, 40, 59])
@pytest.mark.parametrize("where", ["head", "tail", "spread", "anywhere"])
def test_walks_alone_at_full_damage(size, where):
    """Without segments, walks find nearly every passage with exactly the allowed edits, wherever they are."""
    rng, slack = random.Random(size), size // 5
    names = [[f"i{k}w{j}" if j % 3 else f"c{j}" for j in range(size)] for k in range(6)]
    ready = cgk_decontam.Items([(k, " ".join(x)) for k, x in enumerate(names)], cgk_decontam.Plan())
    ready.segments = {}
    texts, want = [], set()
    for k in range(120):
        passage = list(names[k % 6])
        at = {"head": range(slack), "tail": range(size - slack, size), "spread": [(j * size + size // 2) // slack for j in range(slack)], "anywhere": rng.sample(range(size), slack)}[where]
        for j in sorted(at, reverse=True):
            passage[j : j + 1] = [[f"x{j}"], [], [f"x{j}", passage[j]]][rng.randrange(3)]
        texts.append(" ".join([f"n{j}" for j in range(30)] + passage + [f"m{j}" for j in range(30)]))
        want.add((k, k % 6))
    got = {(n, i) for n, i, _, _ in cgk_decontam.matches(ready, texts, cgk_decontam.LEAST)}
    assert got <= want and len(got) >= 0.95 * len(want), len(got)


def test_decontamination_of_common_words():
    """Items of words that most items share match as well."""
    words = [f"c{j}" for j in range(30)]
    items = [(k, " ".join(words[k:] + words[:k])) for k in range(0, 30, 3)]
    texts = [" ".join([w if j % 5 else f"x{j}" for j, w in enumerate(t.split())]) for _, t in items]
    got = {(n, i) for n, i, _, _ in cgk_decontam.matches(cgk_decontam.Items(items, cgk_decontam.Plan()), texts, cgk_decontam.LEAST)}
    assert {(n, i) for n, (i, _) in enumerate(items)} <= got


def test_decontamination_of_repetitive_text():
    """Long repetitive texts end within seconds, and their distances are right."""
    items = cgk_decontam.Items([(1, "aa " * 400), (2, "aa bb " * 100), (3, "one two three four five six seven"), (4, "aa " * 7)], cgk_decontam.Plan())
    began = time.time()
    texts = ["aa " * 20_000, "aa bb " * 100_000 + "one two three four five six seven", "aa cc " * 3000, "aa aa aa aa aa xx aa", "aa bb " * 60]
    got = {(n, i): d for n, i, d, _ in cgk_decontam.matches(items, texts, cgk_decontam.LEAST)}
    assert time.time() - began < 30
    hashed = lambda t: cgk_decontam.word_hashes(t.encode())[0]
    for n, text in enumerate(texts):
        if len(text) < 40_000:
            for k, i in enumerate(items.ids):
                d = cgk_decontam.best_stretch(items.words[k], hashed(text))[0]
                assert got.get((n, i)) == (d if d <= items.slack[k] else None), (n, i)
    assert got[0, 1] == 0 and got[1, 2] == 0 and got[1, 3] == 0 and (2, 1) not in got and got[3, 4] == 1


@pytest.mark.parametrize("kind", ["mixed", "substitutions", "insertions and deletions"])
def test_decontamination_recall_by_kind_of_edit(docs, kind):
    """Items of the benchmark table, each with exactly the allowed edits, in noise of the documents' words."""
    bench = [(r["item_id"], r["text"]) for r in docs.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng, noise = random.Random(kind), [w for r in docs.limit(20).collect() for w in r["text"].split()]
    texts, want = [], []
    for k in range(150):
        i, text = rng.choice(bench)
        words = text.split()
        for j in sorted(rng.sample(range(len(words)), int(0.2 * len(words))), reverse=True):
            change = {"mixed": "sid", "substitutions": "s", "insertions and deletions": "id"}[kind]
            words[j : j + 1] = {"s": ["yyy"], "i": ["zzz", words[j]], "d": []}[rng.choice(change)]
        texts.append(" ".join(rng.choices(noise, k=40) + words + rng.choices(noise, k=40)))
        want.append((k, i))
    got = {(n, i) for n, i, _, _ in cgk_decontam.matches(cgk_decontam.Items(bench, cgk_decontam.Plan()), texts, cgk_decontam.LEAST)}
    assert set(want) <= got


def test_drop_contaminated_by_row(spark):
    passage = " ".join(f"b{j}" for j in range(30))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    rows = [(1, passage, "hit"), (1, "clean text", "clean"), (None, passage + " more", "hit"), (None, None, "clean"), (2, "", "clean"), (2, "", "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string, distance string")
    got = cgk_decontam.drop_contaminated(df, bench)
    assert got.columns == df.columns and [r["distance"] for r in got.collect()] == ["clean"] * 4
    assert cgk_decontam.drop_contaminated(df.limit(0), bench).count() == 0 and cgk_decontam.drop_contaminated(df, bench.limit(0)).count() == 6


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, " ".join(f"W{k}" for k in range(60)))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in cgk_decontam.contaminated(odd, bench).collect()}
    assert {(3, 4), (4, 4), (5, 4)} == got
    assert cgk_decontam.drop_contaminated(odd, bench).where("doc_id IN (3, 4, 5)").count() == 0
    assert cgk_decontam.contaminated(odd.limit(0), bench).count() == 0
    assert cgk_decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_best_stretch():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 7, 4, 9])
    assert cgk_decontam.best_stretch(a, b) == (1, 5)
    assert cgk_decontam.best_stretch(a, b[:0])[0] == 4


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = registry.op1_rule_ensemble(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95


def test_classifier_odd(spark, odd):
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 0)], "doc_id long, quality int")
    model = rule_ensemble.fit(odd, labels)
    rows = rule_ensemble.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = rule_ensemble.fit(odd, labels.limit(0))
    assert {r["score"] for r in rule_ensemble.classify(odd, none).collect()} == {0.5}


def test_compiled_rules_equal_a_walk_of_the_trees(spark):
    """Rules read from trees hold on exactly the rows that reach a node, and the compiled score is the weighted sum of them."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rng, names = random.Random(4), ["a", "b", "c"]
    rows = [(rng.random(), rng.gauss(0, 2), float(rng.randrange(5))) for _ in range(400)]
    rows = [(*r, float((r[0] > 0.4) != (r[1] < 0.5 and r[2] > 1) if rng.random() < 0.9 else rng.random() < 0.5)) for r in rows]
    df = VectorAssembler(inputCols=names, outputCol="x").transform(spark.createDataFrame(rows, "a double, b double, c double, y double"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=3, maxDepth=3, leafCol="leaf", seed=1).fit(df)
    holds = lambda rule, r: all((r[n] <= t) if below else (r[n] > t) for n, below, t in rule)
    every = set()
    for k, tree in enumerate(forest.trees):
        rules = rule_ensemble.tree_rules(tree.toDebugString, names)
        every |= rules
        assert all(len({(n, b) for n, b, _ in rule}) == len(rule) for rule in rules)
        leaves = collections.defaultdict(set)
        for r in forest.transform(df).collect():
            leaves[r["leaf"][k]].add(frozenset(rule for rule in rules if holds(rule, r)))
        # Rows of one leaf agree on every rule of the tree; rows of different leaves don't.
        assert all(len(s) == 1 for s in leaves.values()) and len({next(iter(s)) for s in leaves.values()}) == len(leaves)
    assert rule_ensemble.tree_rules(forest.toDebugString, names) == every
    weights = {rule: rng.gauss(0, 1) for rule in sorted(every)}
    model = rule_ensemble.Ensemble(0.3, tuple(weights.items()))
    for r in df.withColumn("s", model.score()).collect():
        z = 0.3 + sum(v for rule, v in weights.items() if holds(rule, r))
        assert abs(r["s"] - 1 / (1 + np.exp(-z))) < 1e-12


def test_training_rows_are_settled(spark):
    """Repeated ids and tied labels train alike whatever the order of rows."""
    text = lambda k: " ".join(f"w{j}" for j in range(60 + k)) + (" # # # $ $ %" * 20 if k % 2 else "")
    docs = [(k // 2, text(k)) for k in range(120)]
    labels = [(k, k % 2, 0) for k in range(60)] + [(k, 1 - k % 2, 0) for k in range(0, 60, 7)]
    one, two = (
        rule_ensemble.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(x, "doc_id long, quality int, toxic int"), trees=3)
        for d, x in ((docs, labels), (docs[::-1], labels[::-1]))
    )
    assert {r for r, _ in one.weights} == {r for r, _ in two.weights} and abs(one.bias - two.bias) < 1e-6
