"""The composed feature blocks: base, calendar periods, context series and the shape of volatility.

A block is columns of one table: all windows share the exchange by symbol, and all recursive smoothing is one pass.
Every block is of the day itself; features.shift_base moves it one row for use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import oscillators as osc
from ..functions import recursive
from ..functions import windows as w
from ..sources import bars as src
from . import features

col = F.col
ROC, MEANS, RSI, VOLS = (1, 2, 3, 5, 10, 21, 63, 126), (5, 10, 20, 50, 100, 200), (2, 7, 14, 28), (5, 21, 63)


def relative(x, base):
    return w.ratio(x, base) - 1


def base_block(bars: DataFrame) -> DataFrame:
    """bars plus momentum, trend, oscillators, volatility, ranges, volume and candles, normalised so that price levels don't show."""
    c = col("close")
    rows = ind.candles(ind.volume_block(ind.ranges(ind.hurst(ind.volatility(ind.streak(ind.momentum(bars, ROC)), VOLS)))))
    rows = rows.withColumns({f"ret_lag_{k}": w.lag(col("ret"), k - 1) if k > 1 else col("ret") for k in range(1, 6)})
    rows = ind.trend(rows, MEANS)
    rows = rows.withColumns(
        {
            "sma_cross_20_50": relative(col("sma_20"), col("sma_50")), "sma_cross_50_200": relative(col("sma_50"), col("sma_200")),
            "vol_ratio_5_63": F.when(col("rvol_63") > 1e-8, col("rvol_5") / col("rvol_63")), "vol_z_252": w.zscore(col("rvol_21"), 252),
            "overnight_vs_intraday_21": w.mean(col("gap_open"), 21) - w.mean(col("intraday_ret"), 21),
        }
    ).drop(*[f"sma_{n}" for n in MEANS])
    rows = ind.bollinger(ind.mfi(ind.cci(ind.stochastic(rows))))
    rows, steps = osc.inputs(rows), {}
    for n in RSI:
        steps |= osc.rsi_steps(n)
        steps[f"rsi_{n}_d"] = lambda r, n=n: r[f"rsi_{n}"].diff()
    for n in MEANS:
        steps |= {f"__ema_{n}": ("close", recursive.span(n), max(2, n // 2)), f"dist_ema_{n}": lambda r, n=n: osc.ratio(r["close"], r[f"__ema_{n}"]) - 1}
    steps |= osc.macd_steps(line="__line", hist="__hist")
    steps |= {f"macd{m}": lambda r, c=c: osc.ratio(r[c], r["close"]) for m, c in (("", "__line"), ("_signal", "__signal"), ("_hist", "__hist"))}
    steps |= osc.adx_steps(14) | {"__atr": ("__tr", 1 / 14, 14), "atr_14_norm": lambda r: osc.ratio(r["__atr"], r["close"])}
    return recursive.smooth(rows, steps)


def period_block(bars: DataFrame, rule: str, tag: str, least: int = 40) -> DataFrame:
    """bars plus nine features of weekly or monthly bars, of the last period that was over a whole period ago, as of each day.

    A period's own bar is complete only at its end, so its features are moved one period before the days meet them.
    Symbols of fewer than `least` periods have nulls.
    """
    p = src.resample(bars, rule)
    p = p.withColumns({"ret_1": w.change(col("close")), "ret_4": w.change(col("close"), 4), "__n": F.count("*").over(w.Window.partitionBy("symbol"))})
    p = p.withColumns(
        {
            "dist_sma_10": relative(col("close"), w.mean(col("close"), 10)), "dist_sma_30": relative(col("close"), w.mean(col("close"), 30)), "rvol_12": w.deviation(col("ret_1"), 12),
            "__lo": w.lowest(col("close"), 26, 13), "__hi": w.highest(col("close"), 26, 13),
        }
    )
    p = p.withColumn("rangepos_26", w.clip(w.ratio(col("close") - col("__lo"), col("__hi") - col("__lo")), 0.0, 1.0)).withColumnRenamed("__n", "periods").drop("__lo", "__hi")
    steps = osc.rsi_steps(14) | osc.macd_steps(line="__line", hist="__hist") | {"macd_hist": lambda r: osc.ratio(r["__hist"], r["close"])} | osc.adx_steps(14)
    p = recursive.smooth(osc.inputs(p), steps)
    names = ["ret_1", "ret_4", "rsi_14", "dist_sma_10", "dist_sma_30", "rvol_12", "rangepos_26", "adx_14", "macd_hist"]
    shown = p.select("symbol", "date", *[F.when(col("periods") >= least, w.lag(col(c))).alias(f"{tag}_{c}") for c in names])
    return features.as_of(bars, shown, [f"{tag}_{c}" for c in names])


def cross_block(bars: DataFrame, context: DataFrame, tags: dict[str, str], fear: str | None = None, window: int = 63) -> DataFrame:
    """bars plus seven features for each context series: symbol -> tag; a series that has the bars' own symbol gives nulls there.

    fear names the tag whose level, z-score and distance from its 21-day mean are added as x_vix_*.
    """
    rows = bars.withColumns({"__r": w.change(col("close")), "__r21": w.change(col("close"), 21)})
    for symbol, tag in tags.items():
        rows = features.with_context(rows, context, symbol).withColumn("__c", F.when(col("symbol") != symbol, col("ctx_close"))).withColumn("__x", w.change(col("__c")))
        rows = rows.withColumns(
            {
                f"x_{tag}_ret_1": col("__x"), f"x_{tag}_ret_5": w.change(col("__c"), 5), f"x_{tag}_ret_21": w.change(col("__c"), 21),
                f"x_{tag}_dist_sma50": relative(col("__c"), w.mean(col("__c"), 50)), f"x_{tag}_beta_63": w.moving_beta(col("__r"), col("__x"), window),
                f"x_{tag}_corr_63": w.moving_corr(col("__r"), col("__x"), window), f"x_{tag}_rs_21": col("__r21") - w.change(col("__c"), 21),
            }
            | ({"x_vix_level": col("__c"), "x_vix_z_252": w.zscore(col("__c"), 252), "x_vix_term": relative(col("__c"), w.mean(col("__c"), 21))} if tag == fear else {})
        ).drop("ctx_close", "__c", "__x")
    return rows.drop("__r", "__r21")


def volatility_structure(bars: DataFrame, context: DataFrame, spot: str, short: str | None = None, long: str | None = None, vol_of_vol: str | None = None, skew: str | None = None) -> DataFrame:
    """bars plus the shape of implied volatility: ratios of terms, whether they are inverted (0 where unknown), changes and z-scores."""
    rows = bars
    for name, symbol in (("spot", spot), ("short", short), ("long", long), ("vv", vol_of_vol), ("skew", skew)):
        if symbol is not None:
            rows = features.with_context(rows, context, symbol).withColumnRenamed("ctx_close", f"__{name}")
    s, diff = col("__spot"), lambda x, k: x - w.lag(x, k)
    over_one = lambda x: F.coalesce((x > 1).cast("double"), F.lit(0.0))
    if short is not None:
        rows = rows.withColumn("vs_term_9d_1m", F.when(s > 1e-9, col("__short") / s))
        rows = rows.withColumns({"vs_term_9d_1m_z": w.zscore(col("vs_term_9d_1m"), 252), "vs_backwardation_short": over_one(col("vs_term_9d_1m"))})
    if long is not None:
        rows = rows.withColumn("vs_term_1m_3m", F.when(col("__long") > 1e-9, s / col("__long")))
        rows = rows.withColumns({"vs_term_1m_3m_z": w.zscore(col("vs_term_1m_3m"), 252), "vs_backwardation": over_one(col("vs_term_1m_3m")), "vs_term_slope_chg": diff(col("vs_term_1m_3m"), 5)})
    rows = rows.withColumns({"vs_vix_chg_1": diff(s, 1), "vs_vix_chg_5": diff(s, 5), "vs_vix_rel_ma21": relative(s, w.mean(s, 21))})
    if vol_of_vol is not None:
        rows = rows.withColumns({"vs_vvix_z": w.zscore(col("__vv"), 252), "vs_vvix_chg5": diff(col("__vv"), 5), "vs_vvix_vix_ratio": F.when(s > 1e-9, col("__vv") / s)})
    if skew is not None:
        rows = rows.withColumns({"vs_skew_z": w.zscore(col("__skew"), 252), "vs_skew_chg5": diff(col("__skew"), 5)})
    return rows.drop(*[f"__{n}" for n in ("spot", "short", "long", "vv", "skew")])
