"""Technical indicators as column expressions over open, high, low, close and volume.

Indicators that nest windows come as functions from a bars table to the table with their columns, so that the inner window
is worked out once and named.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import windows as w

YEAR = 252


col = F.col


def trend(bars: DataFrame, spans=(5, 20, 50)) -> DataFrame:
    """sma_n, distance of the close from it, its 5-row slope."""
    c = col("close")
    out = bars.withColumns({f"sma_{n}": w.mean(c, n) for n in spans})
    return out.withColumns(
        {f"dist_sma_{n}": w.ratio(c, col(f"sma_{n}")) - 1 for n in spans}
        | {f"sma_slope_{n}": w.change(col(f"sma_{n}"), 5) for n in spans}
    )


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    c = col("close")
    out = bars.withColumns({"__m": w.mean(c, n), "__s": w.deviation(c, n, max(2, n // 2))})
    low, high = col("__m") - k * col("__s"), col("__m") + k * col("__s")
    return out.withColumns(
        {f"bb_width_{n}": w.ratio(high - low, col("__m")), f"bb_pctb_{n}": w.clip(w.ratio(c - low, high - low), -1.0, 2.0)}
    ).drop("__m", "__s")


def stochastic(bars: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    """%K clipped to 0..100, %D the mean of the unclipped %K, and Williams %R."""
    least = max(2, n // 2)
    out = bars.withColumns({"__lo": w.lowest(col("low"), n, least), "__hi": w.highest(col("high"), n, least)})
    out = out.withColumn("__k", 100 * w.ratio(col("close") - col("__lo"), col("__hi") - col("__lo")))
    return out.withColumns(
        {
            f"stoch_k_{n}": w.clip(col("__k"), 0.0, 100.0),
            f"stoch_d_{n}": w.clip(w.mean(col("__k"), d, 1), 0.0, 100.0),
            f"willr_{n}": w.clip(-100 * w.ratio(col("__hi") - col("close"), col("__hi") - col("__lo")), -100.0, 0.0),
        }
    ).drop("__lo", "__hi", "__k")


def cci(bars: DataFrame, n: int = 20) -> DataFrame:
    """Mean deviation is of each row from its own moving mean."""
    least = max(2, n // 2)
    out = bars.withColumn("__tp", (col("high") + col("low") + col("close")) / 3)
    out = out.withColumn("__m", w.mean(col("__tp"), n, least))
    out = out.withColumn("__md", w.mean(F.abs(col("__tp") - col("__m")), n, least))
    return out.withColumn(f"cci_{n}", w.clip(w.ratio(col("__tp") - col("__m"), 0.015 * col("__md")), -500.0, 500.0)).drop("__tp", "__m", "__md")


def obv(bars: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(col("close") - w.lag(col("close"))) * col("volume"), F.lit(0.0))
    return bars.withColumn("__step", step).withColumn("obv", F.sum("__step").over(w.so_far())).drop("__step")


def mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Money flow index; 50 where there is no negative flow to divide by."""
    out = bars.withColumn("__tp", (col("high") + col("low") + col("close")) / 3)
    step = col("__tp") - w.lag(col("__tp"))
    flow = col("__tp") * col("volume")
    out = out.withColumns({"__up": F.when(step > 0, flow).otherwise(0.0), "__dn": F.when(step < 0, flow).otherwise(0.0)})
    total = lambda c: w.observed(max(2, n // 2), col(c), w.over(n), F.sum(c).over(w.over(n)))
    out = out.withColumns({"__a": total("__up"), "__b": total("__dn")})
    return out.withColumn(f"mfi_{n}", F.coalesce(w.clip(100 - 100 / (1 + w.ratio(col("__a"), col("__b"))), 0.0, 100.0), F.lit(50.0))).drop(
        "__tp", "__up", "__dn", "__a", "__b"
    )


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret", w.change(col("close")))


def volatility(bars: DataFrame, spans=(5, 21, 63)) -> DataFrame:
    """Realised and downside volatility of returns, and 21-row Parkinson volatility."""
    out = returns(bars).withColumn("__down", F.when(col("ret") < 0, col("ret")).otherwise(0.0))
    made = {f"rvol_{n}": w.deviation(col("ret"), n) * math.sqrt(YEAR) for n in spans}
    made |= {f"dvol_{n}": w.deviation(col("__down"), n) * math.sqrt(YEAR) for n in spans}
    square = F.pow(F.ln(w.ratio(col("high"), col("low"))), 2)
    out = out.withColumn("__hl", square)
    made["pvol_21"] = F.sqrt(w.mean(col("__hl"), 21) / (4 * math.log(2))) * math.sqrt(YEAR)
    return out.withColumns(made).drop("__down", "__hl")


def hurst(bars: DataFrame, n: int = 63) -> DataFrame:
    """Half the log ratio of the variance of two-row returns to twice that of one-row returns, plus a half."""
    out = returns(bars).withColumn("__r2", col("ret") + w.lag(col("ret")))
    var = lambda c: w.observed(n // 2, col(c), w.over(n), F.var_pop(c).over(w.over(n)))
    out = out.withColumns({"__v1": var("ret"), "__v2": var("__r2")})
    value = F.ln(w.ratio(col("__v2"), 2 * col("__v1"))) / (2 * math.log(2)) + 0.5
    return out.withColumn(f"hurst_{n}", w.clip(value, 0.0, 1.0)).drop("__r2", "__v1", "__v2")


def ranges(bars: DataFrame, spans=(10, 21, 63)) -> DataFrame:
    """Place of the close in the range of closes, and drop from the highest close."""
    c = col("close")
    out = bars
    for n in spans:
        least = max(3, n // 2)
        top = w.highest(c, n, n // 2)
        out = out.withColumns({"__lo": w.lowest(c, n, least), "__hi": w.highest(c, n, least), "__top": top})
        out = out.withColumns(
            {f"rangepos_{n}": w.clip(w.ratio(c - col("__lo"), col("__hi") - col("__lo")), 0.0, 1.0), f"drawdown_{n}": w.ratio(c, col("__top")) - 1}
        )
    return out.drop("__lo", "__hi", "__top")


def streak(bars: DataFrame) -> DataFrame:
    """Signed length of the run of equal signs of return, within ten; zero where flat or unknown."""
    out = returns(bars).withColumn("__sign", F.coalesce(F.signum("ret"), F.lit(0.0)))
    fresh = (col("__sign") != F.coalesce(w.lag(col("__sign")), F.lit(-9.0))).cast("int")
    out = out.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w.so_far()))
    place = F.row_number().over(Window.partitionBy("symbol", "__run").orderBy("date"))
    return out.withColumn("streak", w.clip(col("__sign") * place, -10.0, 10.0)).drop("__sign", "__new", "__run")


def volume_block(bars: DataFrame) -> DataFrame:
    """Volume against its mean and spread, slope of on-balance volume, and traded value against its spread."""
    out = obv(bars).withColumns({"__vm": w.mean(col("volume"), 21), "__dv": col("close") * col("volume"), "__o": F.abs("obv") + 1})
    return out.withColumns(
        {
            "vol_rel_21": w.ratio(col("volume"), col("__vm")), "vol_z_63": w.zscore(col("volume"), 63),
            "obv_slope_21": w.change(col("__o"), 21), "dollar_vol_z": w.zscore(col("__dv"), 63),
        }
    ).drop("__vm", "__dv", "__o", "obv")


def candles(bars: DataFrame) -> DataFrame:
    o, h, l, c = (col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    span = h - l
    return bars.withColumns(
        {
            "candle_body": w.ratio(c - o, span), "upper_wick": w.ratio(h - F.greatest(o, c), span), "lower_wick": w.ratio(F.least(o, c) - l, span),
            "gap_open": w.ratio(o, w.lag(c)) - 1, "intraday_ret": w.ratio(c, o) - 1,
        }
    )


def momentum(bars: DataFrame, spans=(1, 5, 21)) -> DataFrame:
    """Rates of change with their z-scores, bias-corrected skew and kurtosis, share of rising days."""
    out = bars.withColumns({f"roc_{n}": w.change(col("close"), n) for n in spans})
    made = {f"roc_{n}_z": w.zscore(col(f"roc_{n}"), 252) for n in spans if n > 1}
    out = out.withColumn("__up", F.coalesce((col("roc_1") > 0).cast("double"), F.lit(0.0)))
    made |= {"ret_skew_21": w.skew_corrected(col("roc_1"), 21), "ret_kurt_63": w.kurt_corrected(col("roc_1"), 63), "up_days_21": w.mean(col("__up"), 21)}
    return out.withColumns(made).drop("__up")


def overnight(bars: DataFrame, spans=(5, 21)) -> DataFrame:
    """Overnight and intraday returns: means, spread, correlation, spread of volatility and reversal."""
    out = bars.withColumns({"on_ret": w.ratio(col("open"), w.lag(col("close"))) - 1, "id_ret": w.ratio(col("close"), col("open")) - 1})
    made = {}
    for n in spans:
        made |= {f"on_mean_{n}": w.mean(col("on_ret"), n), f"id_mean_{n}": w.mean(col("id_ret"), n), f"on_id_corr_{n}": w.moving_corr(col("on_ret"), col("id_ret"), n)}
    made |= {"on_vol_21": w.deviation(col("on_ret"), 21), "id_vol_21": w.deviation(col("id_ret"), 21), "on_then_id": F.signum("on_ret") * F.signum("id_ret")}
    for name in ("on", "id"):
        made[f"{name}_streak"] = w.observed(3, col(f"{name}_ret"), w.over(5), F.sum(F.signum(f"{name}_ret")).over(w.over(5)))
    out = out.withColumns(made)
    return out.withColumns(
        {f"on_id_spread_{n}": col(f"on_mean_{n}") - col(f"id_mean_{n}") for n in spans} | {"on_id_vol_ratio": w.ratio(col("on_vol_21"), col("id_vol_21")), "on_then_id_21": w.mean(col("on_then_id"), 21)}
    )


def calendar(bars: DataFrame) -> DataFrame:
    d = col("date")
    turn = 2 * math.pi
    return bars.withColumns(
        {
            "cal_dow_sin": F.sin(turn * F.weekday(d) / 5), "cal_dow_cos": F.cos(turn * F.weekday(d) / 5),
            "cal_month_sin": F.sin(turn * F.month(d) / 12), "cal_month_cos": F.cos(turn * F.month(d) / 12),
            "cal_turn_of_month": ((F.day(d) <= 3) | (F.day(d) >= 28)).cast("int"), "cal_dom_norm": F.day(d) / 31.0,
            "cal_quarter_end": ((F.last_day(d) == d) & (F.month(d) % 3 == 0)).cast("int"), "cal_week_of_year": F.weekofyear(d) / 53.0,
        }
    )
