"""Quality classifier as a sparse rule ensemble.

Statistics of whole texts feed a small forest of shallow trees (Spark ML). Every root-to-node path of a tree is
a conjunctive rule over the statistics; a lasso logistic regression over the rules' truth values gives
most of them weight zero, and the rest compile into one Spark column expression that scores any number
of texts without a model object.

Training reads at most `most` labelled rows (the bound is the parameter; rows are chosen by a hash of
their id). Scoring reads only texts.

The setting (trees, depth, lasso) was compared on labelled rows whose remainder is 1, with models fitted on remainders
0 and 3; see README. Held-out rows have no part in a fit or in that choice since.

Defined results: labels other than 0 and 1 and null ids are not trained on; several labels of one id are averaged, and a
tie counts as 1; of several texts of one id that with the smallest hash is trained on; null and empty texts have all statistics zero and are scored like any text; no usable
labels or one class only: every score is the labelled share of class 1, or 0.5 without labels; repeated
rows are scored alike; very long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, quality_rules

Condition = tuple[str, bool, float]  # statistic, at most (else above), threshold


def features(q: Column) -> dict[str, Column]:
    """The statistics rules may use, none of them null."""
    out = dict(quality_rules.ratios(q))
    out["r_log_words"] = F.log1p(q["n_words"])
    out["r_log_lines"] = F.log1p(q["n_lines"])
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in out.items()}


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one column for each statistic)."""
    stats = quality_rules.statistics(docs.select(key, text), text)
    return stats.select(key, *[v.alias(k) for k, v in features(F.col("q")).items()])


def held_out(key: Column) -> Column:
    """Rows never trained on: the unsigned CRC-32 of the id as text leaves 2 modulo 4; a null id isn't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tree_rules(description: str, names: list[str]) -> set[tuple[Condition, ...]]:
    """Every path of the trees in a model's printed form, as sorted conditions, one bound for each side."""
    rules, path = set(), []
    for line in description.splitlines():
        found = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)", line)
        if line.lstrip().startswith("Tree "):
            path = []
        if not found:
            continue
        depth = len(found[1])
        path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[3])], found[4] == "<=", float(found[5])))]
        bounds: dict[tuple[str, bool], float] = {}
        for _, (name, below, at) in path:
            now = bounds.get((name, below))
            bounds[name, below] = at if now is None else (min if below else max)(now, at)
        rules.add(tuple(sorted((name, below, at) for (name, below), at in bounds.items())))
    return rules


def truth(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, below, at in rule:
        out = out & ((F.col(name) <= at) if below else (F.col(name) > at))
    return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """P(label 1) from columns named like the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(truth(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000,
    trees: int = 20, depth: int = 4, lasso: float = 5e-4, seed: int = 7,
) -> Ensemble:
    """Fit on labelled rows that are not held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    one = usable.groupBy(key).agg(F.round(F.avg(label)).cast("double").alias("y"))
    sample = common.cut(one.orderBy(F.xxhash64(F.col(key)), key).limit(most))  # at most `most` narrow rows
    # At most `most` keys; of different texts of one key the one with the smallest hash.
    rows = docs.select(key, text).join(F.broadcast(sample), key).groupBy(key).agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias(text))
    train = common.cut(measured(rows, key, text).join(F.broadcast(sample), key)).drop(key)
    share = train.agg(F.avg("y"), F.count("*")).first()
    if not share[1] or share[0] in (0.0, 1.0):
        p = min(1 - 1e-6, max(1e-6, share[0] if share[1] else 0.5))
        return Ensemble(math.log(p / (1 - p)), ())
    names = [c for c in train.columns if c != "y"]
    assembled = VectorAssembler(inputCols=names, outputCol="x").transform(train)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=seed
    ).fit(assembled)
    rules = sorted(tree_rules(forest.toDebugString, names))
    if not rules:
        return Ensemble(math.log(share[0] / (1 - share[0])), ())
    flags = [f"rule{k}" for k in range(len(rules))]
    fired = train.select("y", *[truth(r).cast("double").alias(f) for r, f in zip(rules, flags)])
    lasso_model = LogisticRegression(
        featuresCol="x", labelCol="y", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60
    ).fit(VectorAssembler(inputCols=flags, outputCol="x").transform(fired))
    found = [(r, float(w)) for r, w in zip(rules, lasso_model.coefficients.toArray()) if w]
    return Ensemble(float(lasso_model.intercept), tuple(found))


def classify(docs: DataFrame, model: Ensemble, key: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs."""
    return (
        measured(docs, key, text)
        .withColumn("score", model.score())
        .select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
    )
