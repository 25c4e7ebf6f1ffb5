"""The pipeline against a plain Python version of all five stages."""

import collections
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tidemark.llm import cgk_decontam, quality_rules, secret_ledger
from tidemark.llm.registry import MODEL_PATH

from test_native import em

SF = "/root/testdata/sf0.001"
sentencepiece = pytest.importorskip("sentencepiece")
regex = pytest.importorskip("regex")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def measures(text):
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    c = collections.Counter(zip(w, w[1:], w[2:]))
    repeat = len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})
    chars, n = sum(map(len, w)), max(1, len(w))
    count = lambda p: len(regex.findall(p, text))
    r = {
        "r_symbols": count(r"[#*$%&|<>]") / n, "r_odd": count(r"[^\p{L}\p{N}.,\s]") / max(1, chars), "r_shout": count("!") / n, "r_caps": count(r"\p{Lu}") / max(1, chars),
        "r_repeat": repeat / n, "r_dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "r_word_length": chars / n, "r_sentence": len(w) / max(1, count("[.?!]")),
    }
    return r, len(w) < 50 or 100 * repeat > 50 * len(w), len(w)


def vote(r, n):
    out = []
    for ratio, good, fair in quality_rules.BANDS.values():
        out.append(-1 if not fair[0] <= r[ratio] <= fair[1] else 1 if good[0] <= r[ratio] <= good[1] else 0)
    return tuple(out) if n else (-1,) * len(out)


def quality(docs):
    seen = {k: measures(t) for k, t in docs.items()}
    patterns = sorted(collections.Counter(vote(r, n) for r, failed, n in seen.values() if not failed).items())
    posterior = dict(zip((p for p, _ in patterns), em(patterns)[2]))
    return {k: t for k, t in docs.items() if not seen[k][1] and posterior[vote(seen[k][0], seen[k][2])] >= 0.5}


def near_dedup(docs):
    fp = {}
    for k, t in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        fp[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    keys, up = sorted(docs), {k: k for k in docs}

    def root(x):
        return x if up[x] == x else root(up[x])

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: docs[k] for k in keys if root(k) == k}


def decontaminate(docs, items):
    hashed = lambda t: np.array([hash(x) for x in words(re.sub("[A-Z]", lambda m: m[0].lower(), t))])
    known = [hashed(t) for t in items]
    return {k: t for k, t in docs.items() if all(cgk_decontam.best_stretch(i, hashed(t))[0] > 0.2 * len(i) for i in known)}


def mask(text):
    spans = []
    for rule in secret_ledger.RULES:
        spans += [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def want(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [docs]
    stages.append(quality(stages[-1]))
    stages.append(near_dedup(stages[-1]))
    stages.append(decontaminate(stages[-1], items))
    stages.append({k: mask(t) for k, t in stages[-1].items()})
    return stages


def test_stages_one_by_one(spark, want, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        assert out.columns == docs.columns, name
        docs = out
        assert {r["doc_id"]: r["text"] for r in out.collect()} == want[k + 1], name
        assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert 0 < len(want[-1]) < len(want[1]) < len(want[0])


def test_run(spark, want):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: library.encode(t) for k, t in want[-1].items()}


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "\t\n", "en", None, 2), (3, "w " * 30_000, None, "b", 60_000),
    *[(k, " ".join(f"word{j} of text{k % 3}." for j in range(40)), "en", "c", 1) for k in (4, 4, 7, 7, 10)],
    (5, " ".join(f"other{j} words here." for j in range(40)) + " password=abcdefgh1", "en", "d", 1), (5, " ".join(f"clash{j} of ids." for j in range(50)), "en", "d", 1),
    (None, " ".join(f"without{j} an id." for j in range(50)), "en", "e", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_odd_tables(spark, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows, shared and missing ids, and clashing columns; then on an empty table."""
    extra = ["q", "rid", "__rid", "fp", "key", "blob", "spans", "path", "distance", "kept", "hot", "__salt"]
    odd = spark.createDataFrame(ODD, SCHEMA)
    for name in extra:
        odd = odd.withColumn(name, odd["source"])
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.parquet(str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r[c] == r["source"] for r in rows for c in extra), name
        assert stage(spark, odd.limit(0), SF).count() == 0, name
    kept = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 5), (True, 0)]
    masked = corpus_pipeline.mask_secrets(spark, odd, SF).collect()
    assert len(masked) == len(ODD) and sum("[SECRET]" in (r["text"] or "") for r in masked) == 1
    tokens = corpus_pipeline.tokenize(spark, odd, SF).collect()
    assert len(tokens) == len(ODD) and sum(r["ids"] is None for r in tokens) == 1 and sum(r["ids"] == [] for r in tokens) == 1
