"""Indicators that rest on recursive smoothing: RSI, MACD, ATR, ADX.

`inputs` makes the columns they smooth; the *_steps are the passes over them, which a block can put together into one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import recursive
from . import windows as w

col = F.col
Steps = dict[str, recursive.Step]


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return (a / b).where(b.abs() > w.EPS)


def moves(bars: DataFrame) -> DataFrame:
    """__up and __dn: the rise and the fall of each close, null on the first row."""
    move = col("close") - w.lag(col("close"))
    rows = bars.withColumns({"__up": F.greatest(move, F.lit(0.0)), "__dn": F.greatest(-move, F.lit(0.0))})
    return rows.withColumns({c: F.when(move.isNotNull(), col(c)) for c in ("__up", "__dn")})


def ranges(bars: DataFrame) -> DataFrame:
    """__tr, __p and __m: true range, and how far highs and lows moved in their own direction."""
    prev, up, down = w.lag(col("close")), col("high") - w.lag(col("high")), w.lag(col("low")) - col("low")
    move = lambda a, b: F.coalesce(F.when((a > b) & (a > 0), a), F.lit(0.0))
    true = F.greatest(col("high") - col("low"), F.abs(col("high") - prev), F.abs(col("low") - prev))
    return bars.withColumns({"__tr": true, "__p": move(up, down), "__m": move(down, up)})


def inputs(bars: DataFrame) -> DataFrame:
    return ranges(moves(bars))


def rsi_steps(n: int) -> Steps:
    """50 where there is no loss to divide by, warm-up included."""
    value = lambda r: (100 - 100 / (1 + ratio(r[f"__up{n}"], r[f"__dn{n}"]))).clip(0, 100).fillna(50.0)
    return {f"__up{n}": ("__up", 1 / n, n), f"__dn{n}": ("__dn", 1 / n, n), f"rsi_{n}": value}


def macd_steps(fast: int = 12, slow: int = 26, signal: int = 9, line: str = "macd", hist: str = "macd_hist") -> Steps:
    """The line of two means, its own mean over `signal` rows of which all must be seen, and their difference."""
    span = lambda x, n, least: (x, recursive.span(n), least)
    return {
        "__fast": span("close", fast, max(2, fast // 2)), "__slow": span("close", slow, max(2, slow // 2)), line: lambda r: r["__fast"] - r["__slow"],
        "__signal": span(line, signal, signal), hist: lambda r: r[line] - r["__signal"],
    }


def adx_steps(n: int) -> Steps:
    index = lambda c: lambda r: 100 * ratio(r[c], r["__trn"])
    bounded = lambda c: lambda r: r[c].clip(0, 100)
    return {
        "__trn": ("__tr", 1 / n, n), "__ps": ("__p", 1 / n, n), "__ms": ("__m", 1 / n, n), "__pdi": index("__ps"), "__mdi": index("__ms"),
        "__dx": lambda r: 100 * ratio((r["__pdi"] - r["__mdi"]).abs(), r["__pdi"] + r["__mdi"]).replace([np.inf, -np.inf], np.nan),
        "__adx": ("__dx", 1 / n, n), f"adx_{n}": bounded("__adx"), f"pdi_{n}": bounded("__pdi"), f"mdi_{n}": bounded("__mdi"),
    }


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    return recursive.smooth(moves(bars), rsi_steps(n))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return recursive.smooth(bars, macd_steps(fast, slow, signal) | {"macd_signal": lambda r: r["__signal"]})


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    return recursive.smooth(ranges(bars), {f"atr_{n}": ("__tr", 1 / n, n)})


def adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return recursive.smooth(ranges(bars), adx_steps(n))
