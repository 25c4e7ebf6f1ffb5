"""Training that searches and selects first: settings from inner folds, features by fold, then the walk-forward run.

One preparation table carries a fold's selection: a feature that the fold did not choose has no spread there, so its
place in the vector is 0, vectors keep one length, and stored models score new rows without knowing of it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import guards, labels, models, verdicts

col = F.col


@dataclass
class Tuned:
    """What a run settled on: picks(fold, feature), trials(family, trial, params, score, auc), the best setting of each family."""

    picks: DataFrame
    trials: DataFrame
    best: dict[str, dict]
    learned: models.Trained


def chosen(train: DataFrame, names: list[str], most: int = 40, purge: int = 2) -> dict[int, list[str]]:
    """The features of each fold, from its training rows alone; a fold where none is fit to use takes all."""
    folds = sorted(r["fold"] for r in train.select("fold").distinct().collect())
    own = lambda k: models.selected(train.where(col("fold") == k).drop("fold"), names, most, purge)
    found = models.in_threads(train.sparkSession, [lambda k=k: own(k) for k in folds])
    return {k: sorted(f) or list(names) for k, f in zip(folds, found)}


def narrowed(fitted: DataFrame, picks: dict[int, list[str]], names: list[str]) -> DataFrame:
    """A preparation table in which features that a fold did not choose have no spread."""
    kept = lambda c: F.when(col("fold").isin([k for k, f in picks.items() if c in f]), col(f"__{c}.sd")).otherwise(0.0)
    return fitted.select("fold", *[col(f"__{c}").withField("sd", kept(c)).alias(f"__{c}") for c in names])


def inner_folds(rows: DataFrame, inner: int = 3, purge: int = 2, embargo: int = 5) -> DataFrame:
    """The first outer fold's training rows with inner folds as fold and role: no test row of any outer fold is among them."""
    least = rows.agg(F.min("fold")).first()[0]
    own = rows.where((col("role") == "train") & (col("fold") == least)).drop("fold", "role")
    fewest = own.groupBy("symbol").count().agg(F.min("count")).first()[0] or 0
    parts = labels.splits(own, inner, purge, embargo, least_train=max(50, int(0.45 * fewest)))
    return labels.membership(own, guards.require_no_overlap(parts, purge))


def tuned(
    rows: DataFrame, names: list[str], families: tuple[str, ...] = models.FAMILIES, trials: int = 6, most: int = 40, inner: int = 3, purge: int = 2, embargo: int = 5,
    seed: int = 7, threshold: float = 0.55, cost_bps: float = 4.0, store=None, refit: bool = False,
) -> tuple[DataFrame, Tuned]:
    """models.walk_forward's rows, with settings found on inner folds and features chosen in each fold, and what was found.

    trials are shared among the families, one each at least. Every inner fold chooses its features and is prepared once for all
    trials. A family none of whose trials has a score is left out; if that leaves none, it is an error.
    """
    keep = store or models._kept
    within = keep(inner_folds(rows, inner, purge, embargo))
    train = within.where("role = 'train'")
    inside = narrowed(models.preparation(train, names), chosen(train, names, most, purge), names)
    found = keep(models.search(within, names, families, max(1, trials // len(families)), seed, threshold, cost_bps, store, inside))
    best = {r["family"]: json.loads(r["params"]) for r in verdicts.best_trials(found).where("score IS NOT NULL").collect()}
    left = tuple(f for f in families if f in best)
    if not left:
        raise guards.DataIntegrityError("no trial of any family has a score: too few rows in the inner folds")
    core = keep(models.roles(rows, purge).where("part = 'core'"))
    picks = chosen(core, names, most, purge)
    fitted = narrowed(models.preparation(core, names), picks, names)
    scored, learned = models.walk_forward(rows, names, left, best, purge, store, refit, fitted)
    table = rows.sparkSession.createDataFrame([(k, f) for k, fs in picks.items() for f in fs], "fold int, feature string")
    return scored, Tuned(table, found, best, learned)
