"""Feature blocks that need joins or today's partial bar: context series, weekly as-of, TODAY block; pruning and guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sketches
from ..functions import windows as w
from ..sources import bars as src

col = F.col


def with_context(bars: DataFrame, context: DataFrame, symbol: str, limit: int = 5) -> DataFrame:
    """bars plus ctx_close: the context series on the bars' own calendar, filled over at most `limit` rows.

    Context days that are not in the calendar go before the fill.
    """
    other = context.where(col("symbol") == symbol).select("date", col("close").alias("__seen"))
    return bars.join(other, "date", "left").withColumn("ctx_close", w.ffill(col("__seen"), limit)).drop("__seen")


def cross_asset(bars: DataFrame, n: int = 63) -> DataFrame:
    rows = bars.withColumns({"ret": w.change(col("close")), "__x": w.change(col("ctx_close"))})
    return rows.withColumns({f"beta_{n}": w.moving_beta(col("ret"), col("__x"), n), f"corr_{n}": w.moving_corr(col("ret"), col("__x"), n)}).drop("__x")


def as_of(rows: DataFrame, periods: DataFrame, values: list[str]) -> DataFrame:
    """rows plus the values of the last period at or before each date, matched nulls included.

    One union and one window by symbol; the payload is a struct, so a null inside it is not skipped.
    """
    payload = F.struct(*[col(v) for v in values])
    kind = periods.select(payload.alias("p")).schema["p"].dataType
    left = rows.select("symbol", "date", F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(kind).alias("__p"))
    right = periods.select("symbol", "date", F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), payload.alias("__p"))

    order = Window.partitionBy("symbol").orderBy("date", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("__last", F.last("__p", ignorenulls=True).over(order)).where("__side = 1")
    return both.select("__row.*", *[col(f"__last.{v}").alias(v) for v in values])


def weekly(bars: DataFrame) -> DataFrame:
    """Weekly return and distance from the 10-week mean, lagged one week, as of each day."""
    periods = src.resample(bars, "week").withColumns({"__r": w.change(col("close")), "__m": w.mean(col("close"), 10)})
    periods = periods.withColumn("__d", w.ratio(col("close"), col("__m")) - 1)
    periods = periods.select("symbol", "date", w.lag(col("__r")).alias("wk_ret_1"), w.lag(col("__d")).alias("wk_dist_sma_10"))
    return as_of(bars, periods, ["wk_ret_1", "wk_dist_sma_10"])


def today(bars: DataFrame) -> DataFrame:
    """Features of a day in progress: its open and anchor price against windows that end the day before.

    Without an anchor column the anchor is the middle of open and close.
    """
    rows = bars if "anchor" in bars.columns else bars.withColumn("anchor", (col("open") + col("close")) / 2)
    prev = w.lag(col("close"))
    rows = rows.withColumn("ret", w.change(col("close"))).withColumns(
        {
            "__sma": w.observed(10, col("close"), w.over(20, 1), F.avg("close").over(w.over(20, 1))),
            "__hi": w.observed(10, col("high"), w.over(21, 1), F.max("high").over(w.over(21, 1))),
            "__lo": w.observed(10, col("low"), w.over(21, 1), F.min("low").over(w.over(21, 1))),
            "__sd": w.deviation(col("ret"), 21, 10, 1), "__prev": prev,
        }
    )
    gain = w.ratio(col("anchor"), col("__prev")) - 1
    return rows.withColumns(
        {
            "tdy_gap": w.ratio(col("open"), col("__prev")) - 1, "tdy_anchor_ret": gain, "tdy_anchor_vs_open": w.ratio(col("anchor"), col("open")) - 1,
            "tdy_anchor_dist_sma20": w.ratio(col("anchor"), col("__sma")) - 1,
            "tdy_anchor_rangepos21": w.clip(w.ratio(col("anchor") - col("__lo"), col("__hi") - col("__lo")), -1.0, 2.0),
            "tdy_anchor_ret_sigma": w.clip(w.ratio(gain, col("__sd")), -10.0, 10.0),
        }
    ).drop("__sma", "__hi", "__lo", "__sd", "__prev")


def shift_base(rows: DataFrame, names: list[str]) -> DataFrame:
    """The causality rule for end-of-day features: every one is taken from the row before."""
    return rows.withColumns({c: w.lag(col(c)) for c in names})


def long_form(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.unpivot(["symbol", "date"], names, "feature", "value")


def feature_quality(rows: DataFrame, names: list[str], share: float = 0.6) -> DataFrame:
    """(feature, coverage, variance) over each symbol's first rows: the later ones are not looked at."""
    place = rows.withColumns({"__rn": F.row_number().over(w.series()), "__n": F.count("*").over(Window.partitionBy("symbol"))})
    head = place.where(col("__rn") <= F.greatest(F.lit(250), F.floor(share * col("__n"))))
    return long_form(head, names).groupBy("feature").agg(F.avg(col("value").isNotNull().cast("double")).alias("coverage"), F.var_pop("value").alias("variance"))


def leak_check(rows: DataFrame, names: list[str], y: str = "y_ret", least: int = 200, most: float = 0.35) -> DataFrame:
    """(feature, n, corr, leak): features whose correlation with the label is too good to be causal."""
    both = rows.select("symbol", "date", y, *names).unpivot(["symbol", "date", y], names, "feature", "value").where(col("value").isNotNull() & col(y).isNotNull())
    sd = F.stddev_pop("value") * F.stddev_pop(y)
    out = both.groupBy("feature").agg(F.count("*").alias("n"), F.when(sd > 1e-12, F.covar_pop("value", y) / sd).alias("corr"))
    return out.withColumn("leak", F.coalesce((col("n") >= least) & (F.abs("corr") > most), F.lit(False)))


def corr_pairs(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, corr) for each pair of features, over rows that have both.

    Sums over pairs are products of matrices, one for each batch, and a task sends one row for each pair, so that
    hundreds of features neither make a plan of tens of thousands of aggregates nor a row for each row and pair.
    """
    k = len(names)
    # Values are taken from their means, so that the sums below lose no digits.
    mids = [v or 0.0 for v in rows.agg(*[F.avg(col(c).cast("double")).alias(c) for c in names]).first()]
    left, right = np.triu_indices(k, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = np.zeros((k, k)), np.zeros((3, k, k))
        for batch in batches:
            x = batch.to_numpy(float, na_value=np.nan) - mids
            seen = (~np.isnan(x)).astype(float)
            x = np.where(seen > 0, x, 0.0)
            n += seen.T @ seen
            sums += np.stack((x.T @ seen, (x * x).T @ seen, x.T @ x))
        at = lambda m: m[left, right]
        yield pd.DataFrame(
            {"i": left, "j": right, "n": at(n), "sx": at(sums[0]), "sy": at(sums[0].T), "sxx": at(sums[1]), "syy": at(sums[1].T), "sxy": at(sums[2])}
        )

    kinds = "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    parts = rows.select(*[col(c).cast("double").alias(c) for c in names]).mapInPandas(run, kinds)
    total = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    spread = lambda ss, s: F.sqrt(F.greatest(col(ss) / col("n") - F.pow(col(s) / col("n"), 2), F.lit(0.0)))
    sd = spread("sxx", "sx") * spread("syy", "sy")
    corr = F.when((col("n") > 0) & (sd > 1e-12), (col("sxy") / col("n") - col("sx") * col("sy") / (col("n") * col("n"))) / sd)
    label = lambda c: F.element_at(F.array(*map(F.lit, names)), col(c) + 1)
    return total.select(label("i").alias("a"), label("j").alias("b"), corr.alias("corr"))


def prune_correlated(rows: DataFrame, names: list[str], most: float = 0.95) -> list[str]:
    """Names kept by decreasing spread, each below `most` correlation with all kept before it."""
    spread = rows.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    near = {frozenset((r["a"], r["b"])) for r in corr_pairs(rows, names).where(F.abs("corr") >= most).collect()}
    kept: list[str] = []
    for name in sorted(names, key=lambda c: (-(spread[c] or 0.0), c)):
        if all(frozenset((name, k)) not in near for k in kept):
            kept.append(name)
    return kept


def term_structure(bars: DataFrame, context: DataFrame, short: str, long: str) -> DataFrame:
    """Ratio of two context series on the bars' calendar, its z-score and change, and whether it is above one.

    The flag of a missing ratio is 0.
    """
    rows = with_context(bars, context, short).withColumnRenamed("ctx_close", "__a")
    rows = with_context(rows, context, long).withColumnRenamed("ctx_close", "__b").withColumn("vs_term", w.ratio(col("__a"), col("__b")))
    return rows.withColumns(
        {"vs_term_z": w.zscore(col("vs_term"), 252), "vs_backwardation": F.coalesce((col("vs_term") > 1).cast("double"), F.lit(0.0)), "vs_term_chg": col("vs_term") - w.lag(col("vs_term")), "vs_chg_5": w.change(col("__a"), 5)}
    ).drop("__a", "__b")


def sequences(rows: DataFrame, names: list[str], length: int = 20) -> DataFrame:
    """rows plus steps: the last `length` feature vectors, the first repeated on the left where there are fewer."""
    got = F.collect_list(F.array(*map(col, names))).over(w.over(length))
    return rows.withColumn("__s", got).withColumn("steps", F.concat(F.array_repeat(F.get("__s", F.lit(0)), length - F.size("__s")), col("__s"))).drop("__s")


def winsorised(rows: DataFrame, names: list[str], sigmas: float = 6.0) -> DataFrame:
    """Values within `sigmas` population deviations of the median of their column; nulls stay."""
    made = rows.agg(*[sketches.sketch(c, sketches.FINE).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    stats = made.select(*[F.struct(sketches.quantile(col(f"m_{c}"), 0.5).alias("m"), col(f"s_{c}").alias("s")).alias(c) for c in names]).first()
    bound = lambda c: w.clip(col(c), stats[c]["m"] - sigmas * stats[c]["s"], stats[c]["m"] + sigmas * stats[c]["s"])
    return rows.withColumns({c: bound(c) for c in names if stats[c]["m"] is not None})


def covered(rows: DataFrame, names: list[str], share: float = 0.7) -> DataFrame:
    """Rows with at least `share` of the features present."""
    present = F.size(F.filter(F.array(*[col(c).cast("double") for c in names]), lambda x: x.isNotNull()))
    return rows.where(present >= share * len(names))
