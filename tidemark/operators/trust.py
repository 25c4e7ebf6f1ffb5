"""How far a result can be trusted: calibration, AUC, overfitting statistics, volatility benchmarks."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w

col = F.col


def calibration(scores: DataFrame, bins: int = 10, least: int = 5) -> DataFrame:
    """(bin, n, mean_p, rate) of scores(y, p) in equal-width bins that hold `least` rows or more."""
    b = F.least(F.floor(col("p") * bins), F.lit(bins - 1)).cast("int")
    return scores.where("y IS NOT NULL AND p IS NOT NULL").groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(col("y").cast("double")).alias("rate")
    ).where(col("n") >= least)


def calibration_summary(scores: DataFrame, bins: int = 10, least: int = 20) -> DataFrame:
    """Brier score, log loss, base rate, skill over the base rate and expected calibration error; null below `least` rows.

    Bins of fewer than five rows add nothing to the error.
    """
    live = scores.where("y IS NOT NULL AND p IS NOT NULL").withColumn("p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), col("p"))))
    p, y = col("p"), col("y").cast("double")
    whole = live.agg(
        F.count("*").alias("n"), F.avg(F.pow(p - y, 2)).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg(y).alias("base_rate")
    )
    ece = calibration(live, bins).agg(F.sum(col("n") * F.abs(col("mean_p") - col("rate"))).alias("__gap"))
    made = whole.join(F.broadcast(ece))  # one row each
    enough = lambda c: F.when(col("n") >= least, c)
    return made.select(
        "n", *[enough(col(c)).alias(c) for c in ("brier", "log_loss", "base_rate")],
        enough(1 - col("brier") / F.nullif(col("base_rate") * (1 - col("base_rate")), F.lit(0.0))).alias("skill"),
        enough(F.coalesce("__gap", F.lit(0.0)) / col("n")).alias("ece"),
    )


def auc(scores: DataFrame, keys: list[str] = []) -> DataFrame:
    """Exact area under the ROC curve for each group of keys: Mann-Whitney by counts of each distinct score, ties half.

    Scores are counted first. The counts are range-partitioned by score and numbered through; what a partition
    has below it is the sum of the partitions before, so that no task sees all scores.
    """
    live = scores.where("y IS NOT NULL AND p IS NOT NULL")
    per = live.groupBy(*keys, "p").agg(F.sum(col("y").cast("long")).alias("pos"), F.sum((1 - col("y")).cast("long")).alias("neg"))
    placed = per.repartitionByRange(*keys, "p").withColumn("__part", F.spark_partition_id())
    by = [*keys, "__part"]
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("__below", inside)
    # One row for each partition and group that has rows in it: pairs within it, and totals.
    parts = rows.groupBy(*by).agg(
        F.sum(col("pos") * (col("__below") + col("neg") / 2)).alias("__u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    before = F.coalesce(F.sum("neg").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("__before", before).groupBy(*keys).agg(
        F.sum(col("__u") + col("pos") * col("__before")).alias("__u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )
    return out.select(*keys, "n_pos", "n_neg", (col("__u") / F.nullif(col("n_pos") * col("n_neg"), F.lit(0))).alias("auc"))


def fold_stability(per_fold: DataFrame, x: str) -> DataFrame:
    sd = F.stddev_samp(x)
    return per_fold.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), sd.alias("sd"), F.avg((col(x) > 0).cast("double")).alias("share_positive"), F.min(x).alias("worst"), F.max(x).alias("best"),
        (F.avg(x) / F.nullif(sd / F.sqrt(F.count(x)), F.lit(0.0))).alias("t_stat"),
    )


def sma_rules(bars: DataFrame, spans: tuple[int, ...] = (5, 10, 15, 20, 30, 40, 50, 60)) -> DataFrame:
    """(symbol, t, config, ret): next-day returns of one rule for each mean length, from the row all rules have."""
    nxt = w.ratio(F.lead("close").over(w.series()), col("close")) - 1
    rows = bars.withColumns({"__y": nxt, "__t": F.row_number().over(w.series())} | {f"__{n}": w.mean(col("close"), n, n) for n in spans})
    rows = rows.where(col("__y").isNotNull() & col(f"__{max(spans)}").isNotNull())
    each = F.array(*[F.struct(F.lit(n).alias("config"), (F.signum(col("close") - col(f"__{n}")) * col("__y")).alias("ret")) for n in spans])
    return rows.select("symbol", (col("__t") - max(spans)).alias("t"), F.inline(each))


def pbo(perf: DataFrame, blocks: int = 8) -> DataFrame:
    """Probability of backtest overfitting by symmetric cross-validation, for each symbol.

    Sharpe of any union of blocks needs only counts, sums and sums of squares of each block and config, so
    rows are aggregated once and the C(blocks, blocks/2) combinations meet the small table.
    """
    n = F.count("*").over(Window.partitionBy("symbol", "config"))
    placed = perf.withColumn("__b", F.floor((col("t") - 1) * blocks / n).cast("int"))
    part = placed.groupBy("symbol", "config", "__b").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(col("ret") * col("ret")).alias("ss"))
    combos = [list(c) for c in combinations(range(blocks), blocks // 2)]
    listed = F.array(*[F.struct(F.lit(k).alias("combo"), F.array(*map(F.lit, c)).alias("train")) for k, c in enumerate(combos)])
    crossed = part.select("*", F.inline(listed)).withColumn("__in", F.array_contains("train", col("__b")))

    def sharpe(inside: Column) -> Column:
        total = lambda c: F.sum(F.when(inside, col(c)))
        mean = total("s") / total("n")
        var = (total("ss") - total("n") * mean * mean) / (total("n") - 1)
        return F.when(var > 1e-18, mean / F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)

    both = crossed.groupBy("symbol", "combo", "config").agg(sharpe(col("__in")).alias("is_sr"), sharpe(~col("__in")).alias("oos_sr"))
    by = Window.partitionBy("symbol", "combo")
    ranks = both.withColumns(
        {
            "__rank": F.rank().over(by.orderBy("oos_sr")) + (F.count("*").over(Window.partitionBy("symbol", "combo", "oos_sr")) - 1) / 2,
            "__n": F.count("*").over(by), "__best": F.row_number().over(by.orderBy(col("is_sr").desc(), "config")),
        }
    ).where("__best = 1")
    share = ranks.withColumn("__w", col("__rank") / (col("__n") + 1)).withColumn("logit", F.ln(col("__w") / (1 - col("__w"))))
    return share.groupBy("symbol").agg(
        F.count("*").alias("n_combos"), F.avg((col("logit") <= 0).cast("double")).alias("pbo"), F.median("logit").alias("median_logit"), F.regr_slope("oos_sr", "is_sr").alias("slope")
    )


def probabilistic_sharpe(sr: float, n: int, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0) -> float | None:
    """Probability that the true Sharpe ratio (of one row, not of a year) beats the benchmark; null below ten rows."""
    if sr is None or n < 10 or not math.isfinite(sr):
        return None
    spread = math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / spread)


def chance_sharpe(trials: int, variance: float | None) -> float:
    """The Sharpe ratio that the best of `trials` chance trials of this variance is expected to have."""
    if trials < 2 or variance is None or not math.isfinite(variance) or variance <= 0:
        return 0.0
    z, gamma = NormalDist().inv_cdf, 0.5772156649015329
    return math.sqrt(variance) * ((1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, trials: int, trial_variance: float, skew: float = 0.0, kurt: float = 3.0) -> tuple[float | None, float]:
    """(probability that a Sharpe ratio beats the best that `trials` chance trials would give, that best)."""
    chance = chance_sharpe(trials, trial_variance)
    return probabilistic_sharpe(sr, n, skew, kurt, chance), chance


def deflated(rows: DataFrame) -> DataFrame:
    """rows(sr, n, trials, variance, skew, kurt) plus deflated and sr0, one vectorised call a batch: Spark SQL has no normal distribution."""

    def run(batches):
        for b in batches:
            made = [deflated_sharpe(*r) for r in zip(b["sr"], b["n"], b["trials"], b["variance"], b["skew"], b["kurt"])]
            yield b.assign(deflated=[m[0] for m in made], sr0=[m[1] for m in made])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], "deflated double", "sr0 double"])
    return rows.mapInPandas(run, schema)


def permutation_p(null: DataFrame, observed: str, keys: list[str], higher: bool = True) -> DataFrame:
    """(keys, observed, n, p_value) of null(keys, x, observed): the share of draws at least as good, the observed one counted in."""
    hit = (col("x") >= col(observed)) if higher else (col("x") <= col(observed))
    live = null.where(col("x").isNotNull() & col(observed).isNotNull())
    return live.groupBy(*keys, observed).agg(F.count("*").alias("n"), ((F.count_if(hit) + 1) / (F.count("*") + 1)).alias("p_value"))


def block_permute(rows: DataFrame, block: int = 20, seed: int = 1, values: tuple[str, ...] = ("y_ret",), sims: int = 1) -> DataFrame:
    """(symbol, sim, __rn, values...): the values of each symbol in blocks of rows dealt anew, `sims` times.

    Order within a block stays, so short memory stays. A block is a quarter of the rows at most. Every
    draw is a dimension of one window, not a loop.
    """
    by = Window.partitionBy("symbol")
    placed = rows.select("symbol", "date", *values).withColumns({"__rn": F.row_number().over(w.series()) - 1, "__n": F.count("*").over(by)})
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.when(col("__n") >= 8, F.floor(col("__n") / 4)).otherwise(F.lit(1))))
    placed = placed.withColumn("__b", F.floor(col("__rn") / size)).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    key = F.xxhash64("symbol", "__b", "sim", F.lit(seed))
    to = F.row_number().over(Window.partitionBy("symbol", "sim").orderBy(key, "__b", "__rn")) - 1
    return placed.select("symbol", "sim", to.alias("__rn"), *values)


def har(bars: DataFrame, h: int = 1) -> DataFrame:
    """Log realised volatility, its 5- and 22-row means, and the log of the mean forward variance over h rows."""
    var = parkinson_bar()
    rv = F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(1e-8))))
    rows = bars.withColumn("rv", rv).withColumn("log_rv", F.ln("rv"))
    rows = rows.withColumns({"har_d": col("log_rv"), "har_w": w.mean(col("log_rv"), 5, 3), "har_m": w.mean(col("log_rv"), 22, 10)})
    ahead = w.series().rowsBetween(1, h)
    target = F.when(F.count("rv").over(ahead) == h, F.ln(F.sqrt(F.avg(col("rv") * col("rv")).over(ahead))))
    return rows.withColumn("log_rv_next", target)


def parkinson_bar() -> Column:
    return F.pow(F.ln(w.ratio(col("high"), col("low"))), 2) / (4 * math.log(2))


def bar_variances(bars: DataFrame) -> DataFrame:
    """Daily volatility by range estimators: Parkinson, Garman-Klass, Rogers-Satchell and one-bar Yang-Zhang."""
    o, h, l, c = (col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    root = lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v, F.lit(0.0))))
    rs = F.ln(h / c) * F.ln(h / o) + F.ln(l / c) * F.ln(l / o)
    gk = 0.5 * F.pow(F.ln(h / l), 2) - (2 * math.log(2) - 1) * F.pow(F.ln(c / o), 2)
    gap = F.pow(F.ln(w.ratio(o, w.lag(c))), 2)
    return bars.withColumns({"vol_parkinson": root(parkinson_bar()), "vol_garman_klass": root(gk), "vol_rogers_satchell": root(rs), "vol_yang_zhang": root((gap + F.pow(F.ln(c / o), 2) + rs) / 3)})


def forecast_scores(rows: DataFrame, y: str, p: str, benchmark: str, keys: list[str]) -> DataFrame:
    """Out-of-sample R2 over a benchmark, QLIKE of both (on variances), and the Mincer-Zarnowitz regression, in one pass."""
    live = rows.where(col(y).isNotNull() & col(p).isNotNull() & col(benchmark).isNotNull())
    r = lambda f: F.exp(2 * (col(y) - col(f)))
    loss = lambda f: F.avg(r(f) - F.ln(r(f)) - 1)
    return live.groupBy(*keys).agg(
        F.count("*").alias("n"), (1 - F.sum(F.pow(col(y) - col(p), 2)) / F.nullif(F.sum(F.pow(col(y) - col(benchmark), 2)), F.lit(0.0))).alias("r2_oos"),
        loss(p).alias("qlike"), loss(benchmark).alias("qlike_benchmark"),
        F.regr_intercept(y, p).alias("mz_alpha"), F.regr_slope(y, p).alias("mz_beta"), F.regr_r2(y, p).alias("mz_r2"),
    )


def diebold_mariano(losses: DataFrame, least: int = 30) -> DataFrame:
    """(symbol, date, d) loss differences -> n, mean and the statistic with Bartlett-weighted autocovariances.

    The number of lags is floor(1.5 n^(1/3)), one at least; lags are a dimension of one aggregate over each symbol's
    ordered differences. Below `least` rows the statistic is null. with_normal_p() adds the p-value.
    """
    by = Window.partitionBy("symbol")
    rows = losses.where(col("d").isNotNull()).withColumns({"__n": F.count("*").over(by), "__c": col("d") - F.avg("d").over(by)})
    sizes = losses.where(col("d").isNotNull()).groupBy("symbol").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most = max(1, int(1.5 * sizes ** (1 / 3) + 1e-9))
    terms = {f"__g{k}": col("__c") * (w.lag(col("__c"), k) if k else col("__c")) for k in range(most + 1)}
    lagged = rows.withColumns(terms)
    lags = F.greatest(F.lit(1), F.floor(1.5 * F.pow(F.max("__n"), F.lit(1 / 3)) + 1e-9))
    n = F.max("__n")
    total = F.sum("__g0") / n
    for k in range(1, most + 1):
        total = total + F.when(lags >= k, 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"__g{k}"), F.lit(0.0)) / n).otherwise(0.0)
    made = lagged.groupBy("symbol").agg(n.alias("n"), F.avg("d").alias("mean_d"), total.alias("long_variance"))
    return made.withColumn("dm", F.when(col("n") >= least, col("mean_d") / F.sqrt(F.greatest(col("long_variance"), F.lit(1e-12)) / col("n"))))


def with_normal_p(rows: DataFrame, z: str, p: str) -> DataFrame:
    """rows plus the two-sided p-value of a standard normal statistic; null stays null."""

    def run(batches):
        for b in batches:
            yield b.assign(**{p: [None if x is None or x != x else math.erfc(abs(x) / math.sqrt(2)) for x in b[z]]})

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema], f"`{p}` double"])
    return rows.mapInPandas(run, schema)


def drift(rows: DataFrame, names: list[str], cut: float = 0.8) -> DataFrame:
    """(feature, share_outside, share_null): later rows of each symbol against the range of its first share."""
    placed = rows.withColumns({"__rn": F.row_number().over(w.series()), "__n": F.count("*").over(Window.partitionBy("symbol"))})
    long = placed.withColumn("__early", col("__rn") <= F.floor(cut * col("__n"))).unpivot(["symbol", "date", "__early"], names, "feature", "value")
    early = F.when(col("__early"), col("value"))
    by = Window.partitionBy("symbol", "feature")
    late = long.withColumns({"lo": F.min(early).over(by), "hi": F.max(early).over(by)}).where("not __early")
    outside = F.when(col("value").isNotNull(), (~col("value").between(col("lo"), col("hi"))).cast("double"))
    return late.groupBy("feature").agg(F.avg(outside).alias("share_outside"), F.avg(col("value").isNull().cast("double")).alias("share_null"))


def yang_zhang(bars: DataFrame, n: int = 21) -> DataFrame:
    """Rolling Yang-Zhang volatility: overnight and open-to-close variances and mean Rogers-Satchell."""
    o, h, l, c = (col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    rows = bars.withColumns(
        {"__on": F.ln(w.ratio(o, w.lag(c))), "__oc": F.ln(w.ratio(c, o)), "__rs": F.ln(h / c) * F.ln(h / o) + F.ln(l / c) * F.ln(l / o)}
    )
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    frame = w.over(n)
    var = lambda x: w.observed(max(2, n // 2), col(x), frame, F.var_samp(x).over(frame))
    total = var("__on") + k * var("__oc") + (1 - k) * w.mean(col("__rs"), n)
    return rows.withColumn("__v", total).withColumn(f"yz_{n}", F.when(col("__v").isNotNull(), F.sqrt(F.greatest(col("__v"), F.lit(0.0))))).drop("__on", "__oc", "__rs", "__v")


def permutation_test(rows: DataFrame, sims: int = 60, block: int = 20, seed: int = 1) -> DataFrame:
    """(symbol, observed, n, p_value): mean of position times y_ret against labels permuted in blocks.

    For rules that are not fitted; models.permutation_test refits. Positions stay in place, returns move.
    """
    live = rows.where("y_ret IS NOT NULL AND position IS NOT NULL")
    here = live.select("symbol", "position", "y_ret", (F.row_number().over(w.series()) - 1).alias("__rn"))
    moved = block_permute(live, block, seed, ("y_ret",), sims).withColumnRenamed("y_ret", "__moved")
    null = moved.join(here.select("symbol", "__rn", "position"), ["symbol", "__rn"]).groupBy("symbol", "sim").agg(F.avg(col("position") * col("__moved")).alias("x"))
    observed = here.groupBy("symbol").agg(F.avg(col("position") * col("y_ret")).alias("observed"))
    return permutation_p(null.join(observed, "symbol"), "observed", ["symbol"])


def footprint(rows: DataFrame, names: list[str], cuts: int = 11) -> DataFrame:
    """(feature, quantiles): the deciles of each feature, kept with a model to judge later rows by."""
    at = F.array(*[F.lit(k / (cuts - 1)) for k in range(cuts)])
    return rows.unpivot(["symbol", "date"], names, "feature", "value").groupBy("feature").agg(F.percentile("value", at).alias("quantiles"))
