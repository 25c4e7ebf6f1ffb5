"""Recursive smoothing: a recurrence over one symbol's rows, which no window frame expresses.

Rows are dealt out by symbol, and one symbol's series is smoothed for all requested columns in one pass, those
that are worked out from smoothed ones included.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: (input column, alpha, least observed rows), or a function of the rows so far
Step = tuple[str, float, int] | Callable[[pd.DataFrame], pd.Series]


def smooth(bars: DataFrame, steps: dict[str, Step]) -> DataFrame:
    """bars plus one column for each step; later steps may read the columns of earlier ones.

    y = x at the first observed row, then alpha * x + (1 - alpha) * y; a missing row carries y while its
    weight decays. Names that begin with two underscores are not returned.
    """
    shown = [name for name in steps if not name.startswith("__")]
    kept = [f for f in bars.schema if not f.name.startswith("__")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"`{name}` double" for name in shown]])
    names = [*[f.name for f in kept], *shown]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        for name, step in steps.items():
            if callable(step):
                rows[name] = step(rows)
            else:
                x, alpha, least = step
                rows[name] = rows[x].astype(float).ewm(alpha=alpha, adjust=False, ignore_na=False, min_periods=least).mean()
        return rows[names]

    return bars.groupBy("symbol").applyInPandas(run, schema)


def span(n: int) -> float:
    return 2 / (n + 1)


def ema(bars: DataFrame, x: str, spans: tuple[int, ...]) -> DataFrame:
    return smooth(bars, {f"ema_{n}": (x, span(n), max(2, n // 2)) for n in spans})
