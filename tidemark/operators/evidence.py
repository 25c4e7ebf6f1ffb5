"""The figures a verdict rests on, by symbol, each worked out from out-of-sample trades: none stood in for.

What could have been traded instead (the candidates: one rule for each feature, on its sign, beside the model) is what
overfitting is measured against: their returns give the probability of overfitting and the variance that the deflated
Sharpe ratio needs. All candidates are columns of one pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w
from . import backtest, models, trust, verdicts

col = F.col


def candidates(trades: DataFrame, rows: DataFrame, names: list[str], cost_bps: float = 4.0) -> DataFrame:
    """(symbol, t, config, ret): net returns of the model's positions and of a rule for each feature, of the model's mean size."""
    size = F.coalesce(F.avg(F.abs("position")).over(Window.partitionBy("symbol")), F.lit(0.0))
    both = trades.select("symbol", "date", "position", "y_ret").join(rows.select("symbol", "date", *names), ["symbol", "date"]).withColumn("__size", size)
    sides = {"model": col("position"), **{f"rule_{c}": F.coalesce(F.signum(c), F.lit(0.0)) * col("__size") for c in names}}
    placed = both.select("symbol", "date", "y_ret", *[p.alias(f"__p_{k}") for k, p in sides.items()])
    nets = {k: col(f"__p_{k}") * col("y_ret") - F.abs(col(f"__p_{k}") - F.coalesce(w.lag(col(f"__p_{k}")), F.lit(0.0))) * (cost_bps / 1e4) for k in sides}
    made = placed.select("symbol", F.row_number().over(w.series()).alias("t"), *[n.alias(k) for k, n in nets.items()])
    return made.unpivot(["symbol", "t"], list(sides), "config", "ret")


def overfitting(perf: DataFrame, blocks: int = 8) -> DataFrame:
    """(symbol, pbo, deflated) of perf(symbol, t, config, ret), where the config named model is the one that trades."""
    sd = F.stddev_samp("ret")
    each = perf.groupBy("symbol", "config").agg(
        F.count("*").alias("n"), F.when(sd > w.EPS, F.avg("ret") / sd).alias("sr"), F.when(sd > w.EPS, F.skewness("ret")).alias("skew"), F.when(sd > w.EPS, F.kurtosis("ret") + 3).alias("kurt")
    )
    spread = each.groupBy("symbol").agg(F.count("sr").cast("int").alias("trials"), F.var_samp("sr").alias("variance"))
    own = each.where("config = 'model' AND sr IS NOT NULL").join(spread, "symbol").select("symbol", "sr", col("n").cast("int").alias("n"), "trials", F.coalesce("variance", F.lit(0.0)).alias("variance"), "skew", "kurt")
    return trust.pbo(perf, blocks).select("symbol", "pbo").join(trust.deflated(own).select("symbol", "deflated"), "symbol", "left")


def skill(oos: DataFrame, least: int = 20) -> DataFrame:
    """(symbol, skill): by how much the Brier score of prob_up beats the base rate's; null below `least` rows."""
    y, base = col("y_cls"), F.avg("y_cls")
    gain = 1 - F.avg(F.pow(col("prob_up") - y, 2)) / F.nullif(base * (1 - base), F.lit(0.0))
    return oos.where("y_cls IS NOT NULL AND prob_up IS NOT NULL").groupBy("symbol").agg(F.when(F.count("*") >= least, gain).alias("skill"))


def continuous(trades: DataFrame, bars: DataFrame, cost_bps: float = 4.0, price: str = "close") -> DataFrame:
    """(symbol, continuous_n, continuous_sharpe): the same positions held from each traded day's price to the next's."""
    held = backtest.continuous_pnl(trades.select("symbol", "date", "position").join(bars.select("symbol", "date", price), ["symbol", "date"]), price, cost_bps)
    sd = F.stddev_samp("net")
    return held.groupBy("symbol").agg(F.count_if(col("position") != 0).alias("continuous_n"), F.when(sd > w.EPS, F.avg("net") / sd * backtest.YEAR**0.5).alias("continuous_sharpe"))


def figures(
    bars: DataFrame, rows: DataFrame, oos: DataFrame, trades: DataFrame, names: list[str], permutations: int = 60, cost_bps: float = 4.0, noise: float = 0.001, store=None
) -> DataFrame:
    """One row for each symbol with every column of verdicts.trading_checks.

    rows carry the features, fold and role; oos prob_up and y_cls; trades are backtest.run's. p_sharpe is that of refits on permuted
    labels, one for all symbols as one model serves all; a figure that can't be worked out (too few rows, no spread) is null.
    """
    hold = backtest.metrics(backtest.buy_and_hold(oos, cost_bps), ["symbol"]).select("symbol", col("sharpe").alias("hold_sharpe"))
    area = trust.auc(oos.select("symbol", col("y_cls").alias("y"), col("prob_up").alias("p")), ["symbol"]).select("symbol", "auc")
    steady = verdicts.fold_figures(trades, ["symbol", "fold"]).groupBy("symbol").agg(F.avg((col("sharpe") > 0).cast("double")).alias("share_positive"))
    once = rows.select("symbol", "date", *names).dropDuplicates(["symbol", "date"])
    perf = (store or models._kept)(candidates(trades, once, names, cost_bps))
    stress = backtest.anchor_stress(trades, noise, cost_bps=cost_bps).select("symbol", col("p05").alias("stress_p05"))
    refits = models.permutation_test(rows, names, permutations, cost_bps=cost_bps, store=store)
    chance = {r["measure"]: r["p_value"] for r in refits.collect()}  # two rows
    made = backtest.metrics(trades, ["symbol"])
    parts = [hold, area, steady, verdicts.base_rates(trades, ["symbol"]).select("symbol", "base_rate"), overfitting(perf), skill(oos), continuous(trades, bars, cost_bps), stress]
    for part in parts:
        made = made.join(part, "symbol", "left")
    return made.withColumn("p_sharpe", F.lit(chance.get("sharpe")).cast("double"))
