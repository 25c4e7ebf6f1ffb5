"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

1 quality rules       documents the rules reject go
2 SimHash near-dedup  one document of each group of near copies stays
3 decontamination     documents that hold a benchmark item go
4 secret scan         secrets are replaced by a mask in the text that goes on
5 SentencePiece       (doc_id, n_tokens, ids): the texts as token ids, decodable to the text

Defined results, stage by stage:

* null and empty texts have no words, fail the base rule of stage 1 and go; given to a later stage alone they are one
  near-dedup group, hold no benchmark item, have no secrets, and become null and empty ids;
* very long texts are read whole by every stage;
* repeated rows are judged alike in stage 1, are one group in stage 2 (one row stays) and are each treated alike after it;
* rows that share an id, or have none, are told apart by their place in the stage's input: stage 2 keeps exactly one
  row of each group, the smallest id first, null ids last, then the text of the smallest hash; stage 3 drops the rows
  that hold an item, whatever their ids;
* ties: a quality posterior of exactly a half keeps the document;
* an empty table gives an empty table after every stage, with the same columns;
* other columns, whatever their names, pass through the first four stages unchanged; n_chars follows a masked text.

The output of a stage is deleted once the next one is written; the last one stays, and is what `run` reads.
"""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import cgk_decontam, common, quality_rules, secret_ledger, sentencepiece_viterbi, simhash
from tidemark.llm.registry import MODEL_PATH


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cgk_decontam.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; n_chars, where there is such a column, follows the text."""
    masked = secret_ledger.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = sentencepiece_viterbi.encode(docs.select("doc_id", "text"), Path(MODEL_PATH).read_bytes())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scan", mask_secrets),
    ("sentencepiece", tokenize),
]
#: Weak supervision, walks and the segmentation are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if k:
            common.discard(spark, f"{folder}/{k - 1}")
    return docs
