"""Decisions from figures: trading and volatility verdicts, roll-ups, leaderboards, base rates and interval coverage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

col = F.col
#: name, condition, whether it is critical, whether a null condition leaves it out (else it fails)
Check = tuple[str, Column, bool, bool]


def decide(figures: DataFrame, checks: Iterable[Check], most_failed: int = 2) -> DataFrame:
    """figures plus checks, n_critical, n_failed and verdict: GO, REVISE with few failed critical checks, else NO-GO."""
    each = [
        F.when(F.lit(not optional) | passed.isNotNull(), F.struct(F.lit(name).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(critical).alias("critical")))
        for name, passed, critical, optional in checks
    ]
    out = figures.withColumn("checks", F.filter(F.array(*each), lambda c: c.isNotNull()))
    out = out.withColumns(
        {"n_critical": F.size(F.filter("checks", lambda c: c["critical"])), "n_failed": F.size(F.filter("checks", lambda c: c["critical"] & ~c["passed"]))}
    )
    return out.withColumn("verdict", F.when(col("n_failed") == 0, "GO").when(col("n_failed") <= most_failed, "REVISE").otherwise("NO-GO"))


def trading_checks(least_trades: int = 60, pbo_alarm: float = 0.35, dsr_alarm: float = 0.90) -> list[Check]:
    """Over n_active, sharpe, sharpe_overlap_adj, auc, directional_accuracy, base_rate, hold_sharpe, pbo, deflated, p_sharpe,
    share_positive, skill, continuous_n, continuous_sharpe and stress_p05; a column may be null, as said for each check.

    The Sharpe that is judged is the one corrected for overlap, where there is one.
    """
    sharpe = F.coalesce("sharpe_overlap_adj", "sharpe")
    cont = F.when((col("continuous_n") > 20) & col("continuous_sharpe").isNotNull(), (col("continuous_sharpe") > 0.3) & F.coalesce(col("continuous_sharpe") > 0.6 * col("sharpe"), F.lit(True)))
    return [
        ("enough trades", col("n_active") >= least_trades, True, False),
        ("positive Sharpe", sharpe > 0.3, True, False),
        ("AUC", col("auc") > 0.52, True, False),
        ("beats the base rate", col("directional_accuracy") - col("base_rate") > 0.005, True, True),
        ("beats buying and holding", sharpe > col("hold_sharpe"), True, True),
        ("low probability of overfitting", col("pbo") <= pbo_alarm, True, True),
        ("overfitting can be worked out", F.when(col("pbo").isNull(), F.lit(False)), False, True),
        ("deflated Sharpe", col("deflated") >= dsr_alarm, True, False),
        ("not by chance", col("p_sharpe") < 0.05, True, False),
        ("steady over folds", col("share_positive") >= 0.6, True, False),
        ("useful calibration", col("skill") > 0, False, False),
        ("tradable", cont, True, True),
        ("robust to the anchor", col("stress_p05") > 0, True, True),
    ]


def volatility_checks() -> list[Check]:
    """Over r2_mean, r2_har, dm, dm_p, qlike, qlike_har, mz_beta and share_better; REVISE with one failure at most."""
    return [
        ("predicts", col("r2_mean") > 0.05, True, False),
        ("beats HAR", col("r2_har") > 0, True, False),
        ("not by chance", (col("dm_p") < 0.05) & (col("dm") < 0), True, False),
        ("beats HAR in QLIKE", col("qlike") < col("qlike_har"), True, False),
        ("scaled", col("mz_beta").between(0.75, 1.25), False, False),
        ("steady over folds", col("share_better") >= 0.6, True, False),
    ]


def base_rates(trades: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, hit, base_rate, edge): how often the side taken was right, against how often the price rises at all."""
    active = F.abs("position") > 1e-9
    right = (F.signum("position") * F.signum("y_ret") > 0).cast("double")
    made = trades.where(col("y_ret").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(active, right)).alias("hit"), F.avg((col("y_ret") > 0).cast("double")).alias("base_rate")
    )
    return made.withColumn("edge", col("hit") - col("base_rate"))


def interval_coverage(rows: DataFrame, y: str, low: str, high: str, keys: list[str]) -> DataFrame:
    """(keys, n, coverage): share of known outcomes inside their interval; rows without an interval don't count."""
    inside = F.when(col(y).isNotNull() & col(low).isNotNull() & col(high).isNotNull(), col(y).between(col(low), col(high)).cast("double"))
    return rows.groupBy(*keys).agg(F.count(inside).alias("n"), F.avg(inside).alias("coverage"))


def roll_up(results: DataFrame, key: str = "horizon") -> DataFrame:
    """results(symbol, key, r2_har, dm_p, verdict) by key: count, mean gain over HAR, how many above it, significant, GO, and which."""
    above = col("r2_har") > 0
    return results.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("r2_har").alias("mean_gain"), F.count_if(above).alias("n_above"), F.count_if(above & (col("dm_p") < 0.05)).alias("n_significant"),
        F.count_if(col("verdict") == "GO").alias("n_go"), F.array_sort(F.collect_list(F.when(col("verdict") == "GO", col("symbol")))).alias("go"),
    )


def leaderboard(results: DataFrame, by: str = "r2_har") -> DataFrame:
    """results with their place by falling figure, nulls last, ties by symbol; one row each, so the window is small."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(col(by).desc_nulls_last(), "symbol")))


def recent(rows: DataFrame, most: int = 120) -> DataFrame:
    """The last `most` rows of each symbol."""
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(col("date").desc()))
    return rows.withColumn("__back", back).where(col("__back") <= most).drop("__back")


def selection_rate(picked: DataFrame) -> DataFrame:
    """picked(fold, feature) -> (feature, rate): the share of folds that chose each feature."""
    folds = picked.agg(F.count_distinct("fold").alias("__folds"))
    return picked.groupBy("feature").agg(F.count_distinct("fold").alias("k")).join(F.broadcast(folds)).select("feature", (col("k") / col("__folds")).alias("rate"))  # one row


def best_trials(trials: DataFrame) -> DataFrame:
    """trials(family, trial, score) -> the best of each family: null scores last, the first trial on ties."""
    best = F.max_by(F.struct(*trials.columns), F.struct(F.coalesce(F.nanvl("score", F.lit(float("-inf"))), F.lit(float("-inf"))), (-col("trial")).alias("t")))
    return trials.groupBy("family").agg(best.alias("b")).select("b.*")


def trial_stats(trials: DataFrame) -> DataFrame:
    """(n, median, best, variance) of the trials' scores; what the deflated Sharpe ratio needs."""
    live = trials.where(col("score").isNotNull() & ~F.isnan("score"))
    return live.agg(F.count("*").alias("n"), F.median("score").alias("median"), F.max("score").alias("best"), F.var_samp("score").alias("variance"))


def keep_first(blocks: DataFrame, keys: list[str], order: str = "fold") -> DataFrame:
    """Out-of-sample blocks of several folds as one table: of rows that share a key the earliest fold's stays."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return blocks.withColumn("__first", first).where("__first = 1").drop("__first")


def variant_choice(candidates: DataFrame, models: DataFrame, default: str = "close") -> DataFrame:
    """(base, variant): of a base's variants that have a stored model, the named winner, else the best verdict, else the default.

    candidates(base, variant, winner, verdict); models(base, variant). A base without any model has no row.
    """
    rank = F.when(col("verdict") == "GO", 2).when(col("verdict") == "REVISE", 1).otherwise(0)
    order = Window.partitionBy("base").orderBy(F.coalesce("winner", F.lit(False)).desc(), rank.desc(), (col("variant") != default), "variant")
    live = candidates.join(models.select("base", "variant").distinct(), ["base", "variant"], "left_semi")
    return live.withColumn("__r", F.row_number().over(order)).where("__r = 1").select("base", "variant")


def runs(symbols: DataFrame, variants: DataFrame) -> DataFrame:
    """(symbol, variant, key, file): every variant of every symbol; the variants are a short list."""
    key = F.when(col("variant") == "close", col("symbol")).otherwise(F.concat_ws("::", "symbol", "variant"))
    safe = F.replace(col("symbol"), F.lit("."), F.lit("_"))
    file = F.when(col("variant") == "close", safe).otherwise(F.concat_ws("__", safe, col("variant")))
    return symbols.select("symbol").withColumn("__one", F.lit(1)).join(F.broadcast(variants.select("variant").withColumn("__one", F.lit(1))), "__one").select("symbol", "variant", key.alias("key"), file.alias("file"))


def fold_figures(scored: DataFrame, keys: list[str] = ["fold"]) -> DataFrame:
    """(keys, n, sharpe, total_return, hit, first, last) of scored(date, y_ret, net, position) by fold."""
    sd = F.stddev_samp("net")
    active = F.abs("position") > 1e-9
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(sd > 1e-12, F.avg("net") / sd * 252**0.5).alias("sharpe"), (F.product(1 + col("net")) - 1).alias("total_return"),
        F.avg(F.when(active, (col("net") > 0).cast("double"))).alias("hit"), F.min("date").alias("first"), F.max("date").alias("last"),
    )
