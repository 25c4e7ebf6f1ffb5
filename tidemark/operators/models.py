"""Walk-forward models on Spark ML: preparation fitted on training rows, model families, search, calibration, stacking.

A fold is a column, not a table: medians, clip bounds and scales of all folds are one aggregate each and meet the rows in
one broadcast join, the prepared vectors are stored once, and the fits of several folds and families run side by side
as Spark jobs from a few driver threads.
"""

from __future__ import annotations

import json
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sketches
from ..functions import windows as w
from . import calibration, features, guards, ridge, trust

col = F.col
#: The version of stored models; others are refused.
FORMAT = 2
#: Fits side by side, and rows for each task of a fit: iterative fits pay for each task in every step.
THREADS, TASK_ROWS = 8, 200_000


def preparation(train: DataFrame, names: list[str], keys: list[str] = ["fold"], q: float = 0.001, slack: float = 0.25) -> DataFrame:
    """(keys, name -> mid, lo, hi, mean, sd) from training rows alone, as struct columns named after the features.

    mid fills gaps; lo and hi are the outer quantiles with `slack` of their distance added; mean and sd are of the
    filled and clipped values.
    """
    # Sketches, so that no task holds a fold's values; materialised once before three quantiles are read off each.
    ends = train.groupBy(*keys).agg(*[sketches.sketch(c).alias(f"__{c}") for c in names])
    ends = ends.select(*keys, *[sketches.quantiles(col(f"__{c}"), [q, 0.5, 1 - q]).alias(f"__{c}") for c in names])
    bound = lambda c: F.struct(
        F.coalesce(F.get(f"__{c}", F.lit(1)), F.lit(0.0)).alias("mid"), F.coalesce(F.get(f"__{c}", F.lit(0)) - slack * (F.get(f"__{c}", F.lit(2)) - F.get(f"__{c}", F.lit(0))), F.lit(0.0)).alias("lo"),
        F.coalesce(F.get(f"__{c}", F.lit(2)) + slack * (F.get(f"__{c}", F.lit(2)) - F.get(f"__{c}", F.lit(0))), F.lit(0.0)).alias("hi"),
    )
    ends = ends.select(*keys, *[bound(c).alias(f"__{c}") for c in names])
    filled = train.join(F.broadcast(ends), keys)  # one row for each fold
    scales = filled.groupBy(*keys).agg(*[F.struct(F.avg(_filled(c)).alias("mean"), F.stddev_pop(_filled(c)).alias("sd")).alias(f"__s_{c}") for c in names])
    both = ends.join(scales, keys)
    return both.select(*keys, *[F.struct(f"__{c}.mid", f"__{c}.lo", f"__{c}.hi", f"__s_{c}.mean", f"__s_{c}.sd").alias(f"__{c}") for c in names])


def _filled(c: str) -> Column:
    return F.greatest(col(f"__{c}.lo"), F.least(col(f"__{c}.hi"), F.coalesce(F.nanvl(col(c).cast("double"), F.lit(None)), col(f"__{c}.mid"))))


def prepared(rows: DataFrame, fitted: DataFrame, names: list[str], keys: list[str] = ["fold"]) -> DataFrame:
    """rows plus x, the filled, clipped and scaled features as a vector; a feature without spread is 0."""
    joined = rows.join(F.broadcast(fitted), keys)  # one row for each fold
    scaled = [F.when(col(f"__{c}.sd") > w.EPS, (_filled(c) - col(f"__{c}.mean")) / col(f"__{c}.sd")).otherwise(0.0) for c in names]
    return joined.withColumn("x", array_to_vector(F.array(*scaled))).drop(*[f"__{c}" for c in names])


def normal_scores(rows: DataFrame, names: list[str], keys: list[str] = ["fold"], train: Column | None = None, cuts: int = 101) -> DataFrame:
    """rows with each feature as the normal score of its place among the training rows' quantiles (the quantile scaler)."""
    own = rows if train is None else rows.where(train)
    table = own.groupBy(*keys).agg(*[sketches.sketch(c).alias(f"__q_{c}") for c in names])
    table = table.select(*keys, *[sketches.quantiles(col(f"__q_{c}"), [k / (cuts - 1) for k in range(cuts)]).alias(f"__q_{c}") for c in names])
    joined = rows.join(F.broadcast(table), keys)  # `cuts` values for each fold and feature
    place = lambda c: F.size(F.filter(f"__q_{c}", lambda v: v <= col(c))) / float(cuts)
    u = lambda c: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), place(c)))
    # The inverse of the normal distribution by its logistic approximation: enough for a scale.
    score = lambda c: F.when(col(c).isNotNull(), F.signum(u(c) - 0.5) * F.sqrt(F.abs(F.ln(4 * u(c) * (1 - u(c)))) * 1.5707963))
    return joined.withColumns({c: score(c) for c in names}).drop(*[f"__q_{c}" for c in names])


COLUMNS = {"featuresCol": "x", "labelCol": "y_cls"}


def estimator(family: str, params: dict, n_features: int, seed: int = 7):
    """A Spark ML estimator of a family. The extra-random-trees and histogram families have the nearest one in their place."""
    if family == "elastic_net":
        return LogisticRegression(elasticNetParam=params.get("l1_ratio", 0.5), regParam=params.get("reg", 0.01), weightCol="weight", maxIter=30, **COLUMNS)
    if family == "forest":
        return RandomForestClassifier(
            numTrees=params.get("trees", 20), maxDepth=params.get("depth", 4), minInstancesPerNode=params.get("least", 20), weightCol="weight", seed=seed, **COLUMNS
        )
    if family == "boosted":
        return GBTClassifier(maxIter=params.get("rounds", 8), maxDepth=params.get("depth", 3), stepSize=params.get("step", 0.1), weightCol="weight", seed=seed, **COLUMNS)
    if family == "perceptron":
        # It takes no weights.
        return MultilayerPerceptronClassifier(layers=[n_features, *params.get("hidden", (16,)), 2], maxIter=params.get("rounds", 30), stepSize=params.get("step", 0.03), seed=seed, **COLUMNS)
    raise ValueError(f"unknown family: {family}")


FAMILIES = ("elastic_net", "forest", "boosted")


def sample_params(family: str, n: int, seed: int = 7) -> list[dict]:
    """n random settings of a family, the same for the same seed."""
    draw = random.Random(f"{family}|{seed}")
    power = lambda a, b: 10 ** draw.uniform(a, b)
    one = {
        "elastic_net": lambda: {"reg": power(-3.5, 0.0), "l1_ratio": draw.uniform(0.0, 1.0)},
        "forest": lambda: {"trees": draw.choice((10, 20, 40)), "depth": draw.choice((3, 4, 5)), "least": draw.choice((10, 25, 50, 100))},
        "boosted": lambda: {"depth": draw.choice((2, 3, 4)), "step": power(-2.2, -0.9), "rounds": draw.choice((5, 10, 20))},
        "perceptron": lambda: {"hidden": draw.choice(((8,), (16,), (16, 8))), "step": power(-3.3, -2.0), "rounds": draw.choice((20, 40))},
    }[family]
    return [one() for _ in range(n)]


def tasks_for(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def in_threads(spark: SparkSession, tasks: list) -> list:
    """The results of functions that run Spark jobs, a few of them side by side."""
    with ThreadPoolExecutor(THREADS) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def probability() -> Column:
    """P(class 1) of a transformed table; a half where a model gives none."""
    return F.coalesce(F.nanvl(vector_to_array("probability")[1], F.lit(0.5)), F.lit(0.5))


def blend(probabilities: list[Column], weights: list[float]) -> Column:
    """Weighted mean of log odds, as a probability."""
    total = F.lit(0.0)
    for p, weight in zip(probabilities, weights):
        total = total + weight * calibration.logit(p)
    return 1 / (1 + F.exp(-total / sum(weights)))


def roles(rows: DataFrame, purge: int = 2, share: float = 0.18, least: int = 120) -> DataFrame:
    """rows(symbol, date, fold, role) with train rows parted into core, gap and cal: the last stretch of each symbol's train rows
    is kept to calibrate on, `purge` rows before it are not used."""
    by = Window.partitionBy("symbol", "fold", "role")
    back = F.row_number().over(by.orderBy(col("date").desc()))
    n = F.count("*").over(by)
    cal = F.least(F.greatest(F.lit(least), F.floor(share * col("__n"))), F.floor(col("__n") / 2))
    out = rows.withColumns({"__back": back, "__n": n}).withColumn("__cal", cal)
    part = F.when(col("role") == "test", "test").when(col("__back") <= col("__cal"), "cal").when(col("__back") <= col("__cal") + purge, "gap").otherwise("core")
    # Halves of cal for weights and for calibrating the blend, and three blocks of each in order of time.
    place = (col("__cal") - col("__back")) / F.greatest(col("__cal"), F.lit(1))
    return out.withColumns({"part": part, "half": F.when(part == "cal", (place >= 0.5).cast("int")), "block": F.when(part == "cal", F.floor(place * 6).cast("int") % 3)}).drop("__back", "__n", "__cal")


@dataclass
class Trained:
    """What a walk-forward run learned; models[fold, family] are Spark ML models."""

    names: list[str]
    families: tuple[str, ...]
    preparation: DataFrame
    models: dict
    calibrators: dict
    weights: dict[tuple, list[float]]
    blend: dict
    footprint: DataFrame
    train_end: str

    def scored(self, x: DataFrame) -> DataFrame:
        """x(fold, x, ...) plus prob_up: families' probabilities calibrated, blended in log odds and calibrated again."""
        out = None
        for fold in sorted({f for f, _ in self.models}):
            part = x.where(col("fold") == fold)
            for family in self.families:
                part = self.models[fold, family].transform(part).withColumn(f"__p_{family}", probability()).drop("rawPrediction", "probability", "prediction")
            out = part if out is None else out.unionByName(part)
        return self.blended(out)

    def blended(self, rows: DataFrame) -> DataFrame:
        ps = [calibration.applied(col(f"__p_{f}"), col("fold"), self.calibrators[f]) for f in self.families]
        rows = rows.withColumns({f"__c_{f}": p for f, p in zip(self.families, ps)})
        mixed = None
        for (fold,), weights in sorted(self.weights.items()):
            made = blend([col(f"__c_{f}") for f in self.families], weights)
            mixed = F.when(col("fold") == fold, made) if mixed is None else mixed.when(col("fold") == fold, made)
        rows = rows.withColumn("__mix", calibration.clipped(mixed))
        return rows.withColumn("prob_up", calibration.applied(col("__mix"), col("fold"), self.blend)).drop(*[f"__{k}_{f}" for f in self.families for k in "pc"])


def walk_forward(
    rows: DataFrame, names: list[str], families: tuple[str, ...] = FAMILIES, best: dict[str, dict] | None = None, purge: int = 2, store=None, refit: bool = False,
    fitted: DataFrame | None = None,
) -> tuple[DataFrame, Trained]:
    """(symbol, date, fold, y_ret, y_cls, prob_up) for every test row of every fold, and what was learned.

    rows carry fold and role (labels.membership), y_ret, y_cls and weight. One model for all symbols in each fold and
    family, fitted on its core rows; calibrators and stacking weights come from the rows kept for that; nothing
    of a fold's test rows is seen. refit: the last fold's models are fitted anew on all its train rows, for use.
    store: how the prepared rows are kept (a function of a table); by default a checkpoint or, without a folder for them, cache.
    best: settings by family; fitted: the preparation of the core rows, where it is not the plain one (tuning.tuned gives both).
    """
    guards.require_columns(rows, [*names, "fold", "role", "y_ret", "y_cls", "weight"])
    parted = roles(rows, purge)
    core = parted.where("part = 'core'")
    fitted = preparation(core, names) if fitted is None else fitted
    keep = ["symbol", "date", "fold", "part", "half", "block", "y_ret", "y_cls", "weight"]
    ready = (store or _kept)(prepared(parted, fitted, names).select(*keep, "x"))
    folds = sorted(r["fold"] for r in ready.select("fold").distinct().collect())
    best, few = best or {}, tasks_for(ready)

    def fit(fold: int, family: str):
        train = ready.where((col("fold") == fold) & (col("part") == "core")).select("x", "y_cls", "weight").coalesce(few)
        return estimator(family, best.get(family, {}), len(names)).fit(train)

    jobs = [(fold, family) for fold in folds for family in families]
    models = dict(zip(jobs, in_threads(rows.sparkSession, [lambda j=j: fit(*j) for j in jobs])))
    learned = Trained(names, families, fitted, models, {f: {} for f in families}, {(k,): [1.0] * len(families) for k in folds}, {}, trust.footprint(core.where(col("fold") == folds[-1]), names), "")
    raw = None
    for fold in folds:
        part = ready.where((col("fold") == fold) & col("part").isin("cal", "test"))
        for family in families:
            part = models[fold, family].transform(part).withColumn(f"__p_{family}", probability()).drop("rawPrediction", "probability", "prediction")
        raw = part.drop("x") if raw is None else raw.unionByName(part.drop("x"))
    raw = (store or _kept)(raw)
    cal = raw.where("part = 'cal'")
    for family in families:
        learned.calibrators[family] = calibration.by_group(cal.select("fold", "block", col("y_cls").alias("y"), col(f"__p_{family}").alias("p")), ["fold"], "platt")
    shown = cal.withColumns({f"__c_{f}": calibration.applied(col(f"__p_{f}"), col("fold"), learned.calibrators[f]) for f in families})
    learned.weights = calibration.stacking_weights(shown.where("half = 0"), [f"__c_{f}" for f in families], ["fold"])
    mixed = learned.blended(cal.where("half = 1"))
    learned.blend = calibration.by_group(mixed.select("fold", "block", col("y_cls").alias("y"), col("__mix").alias("p")), ["fold"])
    learned.train_end = str(parted.where((col("fold") == folds[-1]) & (col("role") == "train")).agg(F.max("date")).first()[0])
    out = learned.blended(raw.where("part = 'test'")).select("symbol", "date", "fold", "y_ret", "y_cls", "prob_up")
    if refit:
        whole = ready.where((col("fold") == folds[-1]) & (col("part") != "test")).select("x", "y_cls", "weight")
        for family, model in zip(families, in_threads(rows.sparkSession, [lambda f=f: estimator(f, best.get(f, {}), len(names)).fit(whole) for f in families])):
            models[folds[-1], family] = model
    return out, learned


def _kept(df: DataFrame) -> DataFrame:
    """Cut with a checkpoint where the session has a folder for them; else held in memory and on disk."""
    given = df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        return df.persist()
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(given)
    return df.checkpoint()


def search(rows: DataFrame, names: list[str], families: tuple[str, ...] = FAMILIES, trials: int = 2, seed: int = 7, threshold: float = 0.55, cost_bps: float = 4.0, store=None, fitted: DataFrame | None = None) -> DataFrame:
    """(family, trial, params, score, auc): random settings, each judged over inner folds by the yearly Sharpe of its trades.

    rows carry the inner folds as fold and role; fitted is their preparation, where it is not the plain one. verdicts.best_trials and verdicts.trial_stats read the result.
    """
    fitted = preparation(rows.where("role = 'train'"), names) if fitted is None else fitted
    ready = (store or _kept)(prepared(rows, fitted, names).select("symbol", "date", "fold", "role", "y_ret", "y_cls", "weight", "x"))
    folds = sorted(r["fold"] for r in ready.select("fold").distinct().collect())
    settings, few = [(f, k, p) for f in families for k, p in enumerate(sample_params(f, trials, seed))], tasks_for(ready)

    def one(family: str, trial: int, params: dict, fold: int) -> DataFrame:
        own = ready.where(col("fold") == fold)
        model = estimator(family, params, len(names), seed + trial).fit(own.where("role = 'train'").select("x", "y_cls", "weight").coalesce(few))
        made = model.transform(own.where("role = 'test'")).select("symbol", "date", "fold", "y_ret", "y_cls", probability().alias("p"))
        return made.select(F.lit(family).alias("family"), F.lit(trial).alias("trial"), "fold", col("y_cls").alias("y"), "p", "y_ret")

    scored = in_threads(rows.sparkSession, [lambda s=s, fold=fold: one(*s, fold) for s in settings for fold in folds])
    every = scored[0]
    for part in scored[1:]:
        every = every.unionByName(part)
    every = (store or _kept)(every)
    side = F.when(col("p") >= threshold, 1.0).when(col("p") <= 1 - threshold, -1.0).otherwise(0.0)
    net = side * col("y_ret") - F.abs(side) * cost_bps / 1e4
    sd = F.stddev_samp(net)
    sharpe = every.where("y_ret IS NOT NULL").groupBy("family", "trial").agg(F.when((F.count("*") >= 30) & (sd > w.EPS), F.avg(net) / sd * 252**0.5).alias("score"))
    area = trust.auc(every, ["family", "trial", "fold"]).groupBy("family", "trial").agg(F.avg("auc").alias("auc"))
    table = rows.sparkSession.createDataFrame([(f, k, json.dumps(p)) for f, k, p in settings], "family string, trial int, params string")
    return table.join(sharpe, ["family", "trial"], "left").join(area, ["family", "trial"], "left")


def permutation_importance(model, hold: DataFrame, names: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance): by how much the AUC of hold(x, y_cls) falls when a feature's values are dealt anew.

    Rows meet the values of another row once; the features are a dimension of one table, not a loop.
    """
    k = len(names)
    placed = hold.select("y_cls", vector_to_array("x").alias("__x"), F.monotonically_increasing_id().alias("__id"))
    # A random order and the plain one are numbered through by ranges, so that no task orders all rows.
    a = placed.select("*", F.row_number().over(Window.partitionBy(F.pmod("__id", F.lit(64))).orderBy("__id")).alias("__r"), F.pmod("__id", F.lit(64)).alias("__g"))
    b = placed.select(col("__x").alias("__o"), F.row_number().over(Window.partitionBy(F.pmod("__id", F.lit(64))).orderBy(F.xxhash64("__id", F.lit(seed)))).alias("__r"), F.pmod("__id", F.lit(64)).alias("__g"))
    both = a.join(b, ["__g", "__r"]).withColumn("j", F.explode(F.sequence(F.lit(-1), F.lit(k - 1))))
    swapped = F.transform("__x", lambda v, i: F.when(i == col("j"), F.get("__o", i)).otherwise(v))
    scored = model.transform(both.select("j", "y_cls", array_to_vector(swapped).alias("x"))).select("j", col("y_cls").alias("y"), probability().alias("p"))
    area = trust.auc(scored, ["j"])
    whole = area.where("j = -1").select(col("auc").alias("__whole"))
    label = F.element_at(F.array(*map(F.lit, names)), col("j") + 1)
    return area.where("j >= 0").join(F.broadcast(whole)).select(label.alias("feature"), (col("__whole") - col("auc")).alias("importance"))  # one row


def selected(rows: DataFrame, names: list[str], most: int = 40, purge: int = 2, least_coverage: float = 0.6, least_variance: float = 1e-10, most_corr: float = 0.95) -> list[str]:
    """Features for a fold from its training rows (symbol, date, y_cls, weight): covered and varying ones, none too like a better
    one, and of these the `most` that a probe model misses most on the last fifth; by variance where the probe can't tell."""
    quality = {r["feature"]: r for r in features.feature_quality(rows, names).collect()}
    kept = [n for n in names if n in quality and quality[n]["coverage"] >= least_coverage and (quality[n]["variance"] or 0) >= least_variance]
    kept = features.prune_correlated(rows, kept, most_corr) if len(kept) > 1 else kept
    if len(kept) <= most:
        return kept
    by = Window.partitionBy("symbol")
    back = F.row_number().over(by.orderBy(col("date").desc()))
    held = F.greatest(F.lit(120), F.floor(0.2 * F.count("*").over(by)))
    parted = rows.withColumns({"__back": back, "__held": held, "fold": F.lit(0)})
    core, hold = parted.where(col("__back") > col("__held") + purge), parted.where(col("__back") <= col("__held"))
    fitted = preparation(core, kept)
    train = prepared(core, fitted, kept).select("x", "y_cls", "weight")
    order = {}
    if train.select("y_cls").distinct().count() == 2:
        probe = estimator("boosted", {"rounds": 10}, len(kept)).fit(train)
        order = {r["feature"]: r["importance"] for r in permutation_importance(probe, prepared(hold, fitted, kept).select("x", "y_cls"), kept).collect()}
    usable = any(v is not None for v in order.values())
    score = (lambda n: order.get(n) or 0.0) if usable else (lambda n: quality[n]["variance"])
    return sorted(kept, key=lambda n: (-score(n), n))[:most]


def permutation_test(rows: DataFrame, names: list[str], sims: int = 20, block: int = 5, seed: int = 7, threshold: float = 0.55, cost_bps: float = 4.0, l2: float = 1.0, store=None) -> DataFrame:
    """(measure, observed, n, p_value) of Sharpe and AUC against refits on labels permuted in blocks.

    rows carry fold, role, y_cls and y_ret. Classes move in blocks within each symbol, and a return takes the side of its
    new class. One family, logistic regression, whose fits for all folds and draws are one aggregate a step; every second
    fold where there are over four. Draw -1 is the real one.
    """
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    used = folds[::2] if len(folds) > 4 else folds
    live = rows.where(col("fold").isin(used) & col("y_ret").isNotNull())
    days = live.select("symbol", "date", "y_cls", "y_ret").distinct()
    moved = trust.block_permute(days, block, seed, ("y_cls",), sims)
    order = days.select("symbol", "date", (F.row_number().over(w.series()) - 1).alias("__rn"))
    fresh = order.join(moved, ["symbol", "__rn"]).select("symbol", "date", "sim", "y_cls")
    labels_ = fresh.unionByName(days.select("symbol", "date", F.lit(-1).alias("sim"), "y_cls"))
    fitted = preparation(live.where("role = 'train'"), names)
    ready = prepared(live, fitted, names).select("symbol", "date", "fold", "role", "y_ret", *[vector_to_array("x")[k].alias(f"x{k}") for k in range(len(names))])
    both = (store or _kept)(ready.join(labels_, ["symbol", "date"]))
    xs = [f"x{k}" for k in range(len(names))]
    beta = calibration.grouped_logit(both.where("role = 'train'"), xs, ["fold", "sim"], l2=l2, rounds=6)
    table = rows.sparkSession.createDataFrame([(int(f), int(s), b.tolist()) for (f, s), b in beta.items()], "fold int, sim int, b array<double>")
    test = both.where("role = 'test'").join(F.broadcast(table), ["fold", "sim"])  # one row for each fold and draw
    z = F.get("b", F.lit(0))
    for k, x in enumerate(xs):
        z = z + F.get("b", F.lit(k + 1)) * col(x)
    p = 1 / (1 + F.exp(-z))
    side = F.when(p >= threshold, 1.0).when(p <= 1 - threshold, -1.0).otherwise(0.0)
    ret = F.when(col("sim") < 0, col("y_ret")).when(col("y_cls") > 0.5, F.abs("y_ret")).otherwise(-F.abs("y_ret"))
    scored = test.select("fold", "sim", col("y_cls").alias("y"), p.alias("p"), (side * ret - F.abs(side) * cost_bps / 1e4).alias("net"))
    sd = F.stddev_samp("net")
    sharpe = scored.groupBy("sim").agg(F.coalesce(F.when(sd > w.EPS, F.avg("net") / sd * 252**0.5), F.lit(0.0)).alias("x")).withColumn("measure", F.lit("sharpe"))
    area = trust.auc(scored, ["sim", "fold"]).groupBy("sim").agg(F.avg("auc").alias("x")).withColumn("measure", F.lit("auc"))
    every = sharpe.unionByName(area)
    real = every.where("sim < 0").select("measure", col("x").alias("observed"))
    return trust.permutation_p(every.where("sim >= 0").join(F.broadcast(real), "measure"), "observed", ["measure"])  # two rows


def save(learned: Trained, spark: SparkSession, folder: str) -> None:
    """The last fold of a run as a model: Spark ML models, calibration, preparation and footprint, with the format."""
    fold = max(f for f, _ in learned.models)
    for family in learned.families:
        learned.models[fold, family].write().overwrite().save(f"{folder}/model/{family}")
    learned.preparation.where(col("fold") == fold).write.mode("overwrite").parquet(f"{folder}/preparation")
    learned.footprint.write.mode("overwrite").parquet(f"{folder}/footprint")
    plain = lambda c: {"kind": c.kind, "a": c.a, "b": c.b, "x": list(c.x), "z": list(c.z)}
    none = calibration.Calibrator()
    about = {
        "format": FORMAT, "fold": fold, "names": learned.names, "families": list(learned.families), "weights": learned.weights[(fold,)], "train_end": learned.train_end,
        "calibrators": {f: plain(learned.calibrators[f].get((fold,), none)) for f in learned.families}, "blend": plain(learned.blend.get((fold,), none)),
    }
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> Trained:
    """A stored model; one of another format is refused."""
    from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel, RandomForestClassificationModel

    about = json.loads(spark.read.text(f"{folder}/about").first()[0])
    if about.get("format") != FORMAT:
        raise guards.DataIntegrityError(f"model of format {about.get('format')}, {FORMAT} is needed: train it again")
    readers = {"elastic_net": LogisticRegressionModel, "forest": RandomForestClassificationModel, "boosted": GBTClassificationModel, "perceptron": MultilayerPerceptronClassificationModel}
    fold, fams = about["fold"], tuple(about["families"])
    calibrator = lambda d: calibration.Calibrator(d["kind"], d["a"], d["b"], tuple(d["x"]), tuple(d["z"]))
    return Trained(
        about["names"], fams, spark.read.parquet(f"{folder}/preparation"), {(fold, f): readers[f].load(f"{folder}/model/{f}") for f in fams},
        {f: {(fold,): calibrator(about["calibrators"][f])} for f in fams}, {(fold,): about["weights"]}, {(fold,): calibrator(about["blend"])},
        spark.read.parquet(f"{folder}/footprint"), about["train_end"],
    )


def score_latest(learned: Trained, rows: DataFrame, back: int = 0) -> DataFrame:
    """(symbol, date, prob_up, position, null_share, outside_share, age_days, warnings): each symbol's last row, or that `back` rows before.

    A missing feature is an error; rows that look unlike the training rows carry warnings.
    """
    from . import backtest

    guards.require_columns(rows, learned.names)
    order = F.row_number().over(Window.partitionBy("symbol").orderBy(col("date").desc()))
    fold = max(f for f, _ in learned.models)
    last = rows.withColumn("__r", order).where(col("__r") == back + 1).withColumn("fold", F.lit(fold))
    x = prepared(last, learned.preparation.where(col("fold") == fold), learned.names).select("symbol", "date", "fold", "x")
    keep = Trained(learned.names, learned.families, learned.preparation, {k: m for k, m in learned.models.items() if k[0] == fold}, learned.calibrators, learned.weights, learned.blend, learned.footprint, learned.train_end)
    made = keep.scored(x).select("symbol", "date", "prob_up", backtest.position(col("prob_up"), cap=0.35).alias("position"))
    return made.join(guards.health(last, learned.footprint, learned.names, learned.train_end or None), ["symbol", "date"])


def har_ols(rows: DataFrame, y: str = "log_rv_next", xs: tuple[str, ...] = ("har_d", "har_w", "har_m"), names: tuple[str, ...] = ("const", "day", "week", "month"), keys: list[str] = ["symbol"]) -> DataFrame:
    """(keys, one column for each term): ordinary least squares by group.

    One aggregate to the sums of the normal equations; they are solved step by step as columns, so that nothing leaves
    the executors. A group whose equations are singular has nulls.
    """
    live = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (y, *xs)))
    terms = [F.lit(1.0), *map(col, xs)]
    k = len(terms)
    made = live.groupBy(*keys).agg(
        *[F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms)], *[F.sum(a * col(y)).alias(f"g{i}_{k}") for i, a in enumerate(terms)]
    )
    # One array column for each equation: the elimination stays small code, however many terms there are.
    made = made.select(*keys, *[F.array(*[f"g{i}_{j}" for j in range(k + 1)]).alias(f"r{i}") for i in range(k)])
    for p in range(k):
        pivot = F.get(f"r{p}", F.lit(p))
        lead = F.transform(f"r{p}", lambda v: v / F.when(F.abs(pivot) > 1e-12, pivot))
        made = made.withColumn(f"r{p}", lead)
        made = made.select(*keys, *[col(f"r{i}") if i == p else F.zip_with(f"r{i}", f"r{p}", lambda a, b: a - b * F.get(f"r{i}", F.lit(p))).alias(f"r{i}") for i in range(k)])
    return made.select(*keys, *[F.get(f"r{i}", F.lit(k)).alias(n) for i, n in enumerate(names)])


def har_predict(rows: DataFrame, coefficients: DataFrame, train: DataFrame, keys: list[str] = ["symbol"], xs: tuple[str, ...] = ("har_d", "har_w", "har_m")) -> DataFrame:
    """rows plus har: the regression's forecast; a missing input is its group's median over the training rows, so that no later row is seen."""
    mids = train.groupBy(*keys).agg(*[sketches.sketch(x).alias(f"__{x}") for x in xs]).select(*keys, *[sketches.quantile(col(f"__{x}"), 0.5).alias(f"__{x}") for x in xs])
    joined = rows.join(mids, keys).join(coefficients, keys)
    fill = lambda x: F.coalesce(col(x), col(f"__{x}"))
    made = joined.withColumn("har", col("const") + sum((col(c) * fill(x) for c, x in zip(("day", "week", "month"), xs)), F.lit(0.0)))
    return made.drop("const", "day", "week", "month", *[f"__{x}" for x in xs])


def shrinkage(rows: DataFrame, residual: str, forecast: str, keys: list[str], least: int = 60) -> DataFrame:
    """(keys, shrink): the weight of a residual forecast that fits best on rows it has not seen, within 0 and 1; 0 for few rows."""
    ok = col(residual).isNotNull() & col(forecast).isNotNull()
    den = F.sum(F.when(ok, col(forecast) * col(forecast)))
    ratio = F.sum(F.when(ok, col(forecast) * col(residual))) / F.nullif(den, F.lit(0.0))
    enough = (F.count_if(ok) >= least) & (den > w.EPS)
    return rows.groupBy(*keys).agg(F.coalesce(F.when(enough, w.clip(ratio, 0.0, 1.0)), F.lit(0.0)).alias("shrink"))


def corrected(har: Column, forecast: Column, shrink: Column, most: float = 0.5) -> Column:
    """The HAR forecast with its shrunk correction, never more than `most` away from it."""
    return w.clip(har + F.coalesce(shrink * forecast, F.lit(0.0)), har - most, har + most)


def volatility_experiment(rows: DataFrame, names: list[str], alphas: tuple[float, ...] = ridge.ALPHAS, purge: int = 2, store=None) -> DataFrame:
    """(symbol, date, fold, y, har, ml, mu): forecasts of log volatility on every test row, by HAR alone, with a residual model, and by the training mean.

    rows carry trust.har's columns, fold and role. HAR is fitted by symbol and fold on core rows and refitted on all train rows
    for use; what it leaves is fitted by ridge (the penalty of 30 with the least cross-validation score) and boosted trees, for all symbols
    together; their mean is shrunk by what it is worth on cal rows, which it has not seen.
    """
    keys, y = ["symbol", "fold"], "log_rv_next"
    parted = (store or _kept)(roles(rows.where(col(y).isNotNull()), purge))
    within = parted.where("part = 'core'")
    core = har_ols(within, keys=keys)
    base = har_predict(parted, core, within, keys).withColumn("resid", col(y) - col("har"))
    fitted = preparation(within, names)
    ready = (store or _kept)(prepared(base, fitted, names).select("symbol", "date", "fold", "part", "role", y, "har", "resid", "x"))
    folds, few = sorted(r["fold"] for r in ready.select("fold").distinct().collect()), tasks_for(ready)

    # All folds and penalties from one aggregate.
    xs = vector_to_array("x")
    wide = ready.where("part = 'core'").select("fold", "resid", *[xs[k].alias(f"x{k}") for k in range(len(names))])
    linear = ridge.paths(wide, [f"x{k}" for k in range(len(names))], ["fold"], "resid", alphas)

    def one(fold: int) -> DataFrame:
        own = ready.where(col("fold") == fold)
        train = own.where((col("part") == "core") & col("resid").isNotNull()).select("x", col("resid").alias("label")).coalesce(few)
        trees = GBTRegressor(featuresCol="x", maxIter=5, maxDepth=3, stepSize=0.1, minInstancesPerNode=20, seed=7 + fold).fit(train)
        out = trees.transform(own.where("part IN ('cal', 'test')")).withColumnRenamed("prediction", "__b")
        out = out.withColumn("__a", ridge.predicted(xs, [col("fold")], {k: p for k, p in linear.items() if k == (fold,)}))
        return out.withColumn("guess", (F.coalesce("__a", "__b") + col("__b")) / 2).drop("__a", "__b", "x")

    made = None
    for part in in_threads(rows.sparkSession, [lambda f=f: one(f) for f in folds]):
        made = part if made is None else made.unionByName(part)
    made = (store or _kept)(made)
    weight = shrinkage(made.where("part = 'cal'"), "resid", "guess", keys)
    train = parted.where("role = 'train'")
    mean = train.groupBy(*keys).agg(F.avg(y).alias("mu"))
    final = har_predict(parted.where("part = 'test'"), har_ols(train, keys=keys), train, keys).join(mean, keys).select("symbol", "date", "fold", y, "har", "mu")
    out = final.join(made.where("part = 'test'").select("symbol", "date", "fold", "guess"), ["symbol", "date", "fold"]).join(weight, keys)
    return out.select("symbol", "date", "fold", col(y).alias("y"), "har", "mu", corrected(col("har"), col("guess"), col("shrink")).alias("ml"))
