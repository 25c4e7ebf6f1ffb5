"""Positions, cost-aware backtests and their metrics, for all symbols at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

col = F.col
YEAR = 252


def position(
    p: Column, sizing: str = "continuous", threshold: float = 0.55, gain: float = 1.0, cap: float = 1.0, least: float = 0.02, short: bool = True,
    leverage: float = 1.0, expected: Column | None = None, sigma: Column | None = None, fraction: float = 0.25,
) -> Column:
    """Size from a calibrated probability; null gives zero.

    continuous: in proportion to the distance from a half, nothing below `least`. The others act beyond the threshold:
    binary with one unit, confidence by the excess over the threshold, kelly by a fraction of expected return over
    variance. These three are cut off at the smaller of cap and leverage.
    """
    if sizing == "continuous":
        size = w.clip((p - 0.5) / 0.5 * gain, -cap if short else 0.0, cap)
        return F.coalesce(F.when(F.abs(size) >= least, size), F.lit(0.0))
    up, down = p >= threshold, (p <= 1 - threshold) if short else F.lit(False)
    if sizing == "binary":
        raw = F.when(up, 1.0).when(down, -1.0).otherwise(0.0)
    elif sizing == "confidence":
        scale = max(1e-6, 1 - threshold)
        raw = F.when(up, (p - threshold) / scale).when(down, -((1 - threshold) - p) / scale).otherwise(0.0)
    elif sizing == "kelly":
        if expected is None or sigma is None:
            raise ValueError("kelly sizing needs an expected return and a sigma")
        raw = F.when(up | (p <= 1 - threshold), expected / F.greatest(sigma * sigma, F.lit(1e-8)) * fraction).otherwise(0.0)
    else:
        raise ValueError(f"unknown sizing: {sizing}")
    most = min(cap, leverage)
    return F.coalesce(w.clip(raw, -most, most), F.lit(0.0))


def coherent(pos: Column, median: Column) -> Column:
    """Zero where the position and the median forecast point different ways."""
    return F.when(median.isNotNull() & (F.signum(pos) != 0) & (F.signum(pos) != F.signum(median)), 0.0).otherwise(pos)


def rule_signals(bars: DataFrame, n: int = 20, size: float = 0.25, extreme: float = 0.6) -> DataFrame:
    """bars plus y_ret (next close over close; null where extreme) and `size` on the side of yesterday's
    distance from the n-row mean."""
    rows = bars.withColumns({"__sma": w.mean(col("close"), n), "y_ret": w.ratio(F.lead("close").over(w.series()), col("close")) - 1})
    rows = rows.withColumns({"__side": size * F.signum(w.ratio(col("close"), col("__sma")) - 1), "y_ret": F.when(F.abs("y_ret") <= extreme, col("y_ret"))})
    return rows.withColumn("position", F.coalesce(w.lag(col("__side")), F.lit(0.0))).drop("__sma", "__side")


def run(rows: DataFrame, cost_bps: float = 4.0, pos: str = "position", ret: str = "y_ret") -> DataFrame:
    """rows with y_ret plus gross, turnover, cost, net, equity and drawdown; one-way cost on turnover."""
    live = rows.where(col(ret).isNotNull())
    before = F.coalesce(w.lag(col(pos)), F.lit(0.0))
    out = live.withColumns({"turnover": F.abs(col(pos) - before), "gross": col(pos) * col(ret)})
    out = out.withColumn("cost", col("turnover") * (cost_bps / 1e4)).withColumn("net", col("gross") - col("cost"))
    out = out.withColumn("equity", F.product(1 + col("net")).over(w.so_far()))
    return out.withColumn("drawdown", col("equity") / F.max("equity").over(w.so_far()) - 1)


def metrics(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key group of run() rows: return, risk, hit, overlap and tail figures in one aggregate."""
    lagged = trades.withColumns({"__x1": w.lag(col("net")), "__p1": w.lag(col("position"))})
    x = col("net")
    pair = col("__x1").isNotNull()
    a, b = F.when(pair, x), F.when(pair, col("__x1"))
    active = F.abs("position") > 1e-9
    direction = F.signum("position") * F.signum("y_ret")
    n, sd = F.count(x), F.stddev_samp(x)
    loss = F.sum(F.when(x < 0, x))
    made = lagged.groupBy(*keys).agg(
        n.alias("n"), F.count_if(active).alias("n_active"), F.avg(x).alias("mean"), sd.alias("sd"),
        F.when(F.count_if(x < 0) > 2, F.stddev_samp(F.when(x < 0, x))).alias("sd_down"),
        F.min("drawdown").alias("max_dd"), F.max_by("equity", "date").alias("final"),
        F.avg(F.when(active, (x > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(active, (direction > 0).cast("double"))).alias("directional_accuracy"),
        F.when(loss < 0, F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)) / F.abs(loss)).alias("profit_factor"),
        F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, x)).alias("avg_loss"),
        F.avg(active.cast("double")).alias("exposure"), F.avg((active & F.coalesce(F.abs("__p1") > 1e-9, F.lit(False))).cast("double")).alias("overlap_frac"),
        F.when(F.stddev_pop(a) * F.stddev_pop(b) > 1e-12, F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).alias("autocorr_1"),
        F.when(F.var_pop(x) > 1e-18, F.skewness(x)).alias("skew"), F.when(F.var_pop(x) > 1e-18, F.kurtosis(x) + 3).alias("kurtosis"),
        F.min(x).alias("worst_day"), F.max(x).alias("best_day"), F.avg("turnover").alias("turnover_mean"), (F.avg("cost") * YEAR).alias("cost_drag_annual"),
    )
    root = math.sqrt(YEAR)
    made = made.withColumns(
        {
            "sharpe": F.when(col("sd") > 1e-12, col("mean") / col("sd") * root), "sortino": F.when(col("sd_down") > 1e-12, col("mean") / col("sd_down") * root),
            "cagr": F.when(col("final") > 0, F.pow("final", F.lit(float(YEAR)) / col("n")) - 1), "total_return": col("final") - 1, "vol_annual": col("sd") * root,
            "t_stat": F.when(col("sd") > 1e-12, col("mean") / (col("sd") / F.sqrt("n"))),
            "newey_west_factor": F.when(F.abs("autocorr_1") > 1e-6, F.sqrt(F.greatest(F.lit(1e-6), 1 + 2 * col("autocorr_1") * (1 - 1 / F.greatest(col("n"), F.lit(2)))))).otherwise(1.0),
        }
    )
    return made.withColumns(
        {"calmar": F.when(col("max_dd") < -1e-9, col("cagr") / F.abs("max_dd")), "sharpe_overlap_adj": col("sharpe") / col("newey_west_factor")}
    ).drop("mean", "sd", "sd_down", "final")


def by_year(trades: DataFrame, least: int = 20) -> DataFrame:
    x = col("net")
    sd = F.stddev_samp(x)
    return trades.groupBy("symbol", F.year("date").alias("year")).agg(
        F.count("*").alias("n"), (F.product(1 + x) - 1).alias("ret"), F.when(sd > 1e-12, F.avg(x) / sd * math.sqrt(YEAR)).alias("sharpe"),
        F.avg((x > 0).cast("double")).alias("hit"),
    ).where(col("n") >= least)


def continuous_pnl(bars: DataFrame, price: str = "close", cost_bps: float = 4.0) -> DataFrame:
    """Price-to-price returns held from each row to the next, net of one-way cost."""
    rows = bars.withColumn("y_ret", w.ratio(F.lead(price).over(w.series()), col(price)) - 1)
    return run(rows, cost_bps)


def buy_and_hold(rows: DataFrame, cost_bps: float = 4.0) -> DataFrame:
    """run() of one unit held on every row."""
    return run(rows.withColumn("position", F.lit(1.0)), cost_bps)


def portfolio(trades: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Equal-weight mean of the symbols that trade on each day, with its compounded value.

    verdicts(symbol, verdict): symbols that are NO-GO are left out, those without a verdict stay.
    """
    if verdicts is not None:
        trades = trades.join(verdicts.where("verdict = 'NO-GO'").select("symbol"), "symbol", "left_anti")
    days = trades.groupBy("date").agg(F.avg("net").alias("net"), F.count("*").alias("k"))
    one = w.Window.orderBy("date").rowsBetween(w.Window.unboundedPreceding, 0)  # one row a day
    return days.withColumn("equity", F.product(1 + col("net")).over(one))


def portfolio_by_year(days: DataFrame, least: int = 30) -> DataFrame:
    """portfolio() rows by calendar year; years of fewer than `least` days are left out."""
    sd = F.stddev_samp("net")
    return days.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("n"), (F.product(1 + col("net")) - 1).alias("ret"), F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(YEAR)).alias("sharpe")
    ).where(col("n") >= least)


def diversification(trades: DataFrame) -> DataFrame:
    """(k, mean_corr, mean_sharpe, independent, correlated): the mean correlation of pairs, and the Sharpe that k symbols of
    the mean Sharpe would have together without it and with it."""
    sd = F.stddev_samp("net")
    each = trades.groupBy("symbol").agg(F.when(sd > 1e-12, F.avg("net") / sd * math.sqrt(YEAR)).alias("sharpe"))
    one = each.agg(F.count("sharpe").alias("k"), F.avg("sharpe").alias("mean_sharpe"))
    made = one.join(F.broadcast(pair_correlations(trades).agg(F.avg("corr").alias("mean_corr"))))  # one row each
    k, rho = col("k"), col("mean_corr")
    return made.select(
        "k", "mean_corr", "mean_sharpe", (col("mean_sharpe") * F.sqrt(k)).alias("independent"),
        (col("mean_sharpe") * F.sqrt(k / F.greatest(1 + (k - 1) * F.coalesce(rho, F.lit(0.0)), F.lit(1e-9)))).alias("correlated"),
    )


def pair_correlations(trades: DataFrame) -> DataFrame:
    """(a, b, n, corr) of the daily net returns of each pair of symbols."""
    a = trades.select("date", col("symbol").alias("a"), col("net").alias("x"))
    b = trades.select("date", col("symbol").alias("b"), col("net").alias("y"))
    sd = F.stddev_pop("x") * F.stddev_pop("y")
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.when(sd > 1e-12, F.covar_pop("x", "y") / sd).alias("corr"))


def anchor_stress(trades: DataFrame, noise: float, sims: int = 50, seed: int = 7, cost_bps: float = 4.0) -> DataFrame:
    """(symbol, mean, p05 and p95 of Sharpe) when every entry price is off by normal noise; sims is a dimension."""
    sim = trades.sparkSession.range(sims).select(col("id").alias("sim"))
    off = trades.crossJoin(F.broadcast(sim)).withColumn("__e", F.randn(seed) * noise)
    net = col("position") * ((1 + col("y_ret")) / (1 + col("__e")) - 1) - col("cost")
    each = off.groupBy("symbol", "sim").agg((F.avg(net) / F.nullif(F.stddev_samp(net), F.lit(0.0)) * math.sqrt(YEAR)).alias("sharpe"))
    q = F.percentile("sharpe", F.array(F.lit(0.05), F.lit(0.95)))
    return each.groupBy("symbol").agg(F.avg("sharpe").alias("mean"), q[0].alias("p05"), q[1].alias("p95"))


def thinned(rows: DataFrame, most: int = 260) -> DataFrame:
    """About `most` rows of each symbol at even steps, and its last."""
    n = F.count("*").over(w.Window.partitionBy("symbol"))
    placed = rows.withColumns({"__rn": F.row_number().over(w.series()), "__n": n})
    step = F.greatest(F.lit(1), F.floor(col("__n") / most))
    return placed.where(((col("__rn") - 1) % step == 0) | (col("__rn") == col("__n"))).drop("__rn", "__n")
