"""The registered queries of the corpus operators and the SQL they are compared with."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    cgk_decontam,
    common,
    divergence,
    hard_negatives,
    license_scan,
    ngram_jaccard,
    pfp_dedup,
    quality_rules,
    ring_sharding,
    rule_ensemble,
    secret_ledger,
    sentencepiece_viterbi,
    simhash,
    url_filter,
)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.table(spark, sf_dir, t) for t in ("documents", "labels"))
    return rule_ensemble.classify(docs, rule_ensemble.fit(docs, labels))


def op2_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_sharding.assign(common.table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_pfp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pfp_dedup.dedup(common.table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.assess(common.table(spark, sf_dir, "documents"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *[F.col(f"q.{c}").alias(c) for c in base], "base_failed", "kept", "quality_probability"
    )


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans: the base rules, then all rules against the stored ledger, which leaves only the added ones to apply."""
    rows = common.stored(secret_ledger.addressed(common.table(spark, sf_dir, "documents")))
    folder = f"{common.shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    first = secret_ledger.update(rows, None, secret_ledger.BASE_RULES, 1).write(f"{folder}/1")
    second = secret_ledger.update(rows, first, secret_ledger.RULES, 2).write(f"{folder}/2")
    found = secret_ledger.findings(rows, second)
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = [r.kind for r in secret_ledger.BASE_RULES]
    base_spans = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secret_ledger.as_text(base_spans).cast("binary"), 256).alias("base_sha256"),
        secret_ledger.as_text(F.col("spans")).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


#: A parameter: where the public SentencePiece model lies on the driver.
MODEL_PATH = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op7_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL_PATH) -> DataFrame:
    model = Path(model_path).read_bytes()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    made = sentencepiece_viterbi.encode_and_decode(docs, model)
    return made.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (common.table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return cgk_decontam.contaminated(docs, benchmark)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select(
        "doc_id", "licence", "dice",
        F.array_join(F.array_sort(F.array_distinct(F.transform("licence_units", lambda u: u["licence"]))), ",").alias("licences"),
        F.size("licence_units").cast("long").alias("n_matches"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.classify(pages, url_filter.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.groups(common.table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, anchors are every hundredth row; both are the query's own rules."""
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(common.table(spark, sf_dir, "embeddings"), relabel=relabel)
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


OP10_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN position('://' IN coalesce(url, '')) > 0
              THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(verdict, h, p) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
       arg_max(h || p, length(h) * 1000 + length(p)) FILTER (WHERE h IS NOT NULL) AS rule,
       coalesce(arg_max(verdict, length(h) * 1000 + length(p)) FILTER (WHERE h IS NOT NULL), 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT id, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
whole AS (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v)::HUGEINT AS p
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(whole.total) + 5 * any_value(v.v))::HUGEINT AS q
  FROM c JOIN whole USING (lang) JOIN v USING (lang) GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(any_value(f.value), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source GROUP BY a.lang, a.source, b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
both_parts AS (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL BY NAME
  SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM both_parts
"""

OP13_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, a.label = b.label AS same, b.id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor, id AS positive_id, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT anchor AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, ps AS positive_score, score AS negative_score
FROM pos JOIN s USING (anchor) WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
QUALIFY rank <= 10
"""

QUERIES = {
    "op1_rule_ensemble": op1_rule_ensemble,
    "op2_ring_sharding": op2_ring_sharding,
    "op3_pfp_dedup": op3_pfp_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_ledger": op5_secret_ledger,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_source_divergence": op11_source_divergence,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL = {"op10_url_filter": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_hard_negatives": OP13_SQL}
