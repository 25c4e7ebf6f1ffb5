"""Forward labels, sample weights and purged walk-forward splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

col = F.col
EXIT = {"close_next": ("close", 1), "open_next": ("open", 1), "close_next2": ("close", 2)}


def build(bars: DataFrame, horizon: str = "close_next", entry: str = "close", max_gap: int = 5, extreme: float = 0.6, threshold: float = 0.0) -> DataFrame:
    """bars plus y_ret, sigma (known before the day), y_norm, y_cls and valid.

    A label is invalid where the exit lies over max_gap days off the row before it, or the return is extreme.
    """
    price, h = EXIT[horizon]
    rows = bars.withColumns(
        {"__ret": w.change(col("close")), "__exit": F.lead(price, h).over(w.series()), "__gap": F.datediff(F.lead("date", h).over(w.series()), F.lead("date", h - 1).over(w.series()))}
    )
    sd = w.deviation(col("__ret"), 21, 10, 1)
    rows = rows.withColumns({"y_ret": w.ratio(col("__exit"), col(entry)) - 1, "__sd": F.when(sd.isNotNull(), F.greatest(sd, F.lit(1e-4)) * math.sqrt(h))})
    rows = rows.withColumn("sigma", w.ffill(col("__sd")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns(
        {
            "y_norm": w.clip(col("y_ret") / col("sigma"), -8.0, 8.0), "y_cls": F.when(yes(col("y_ret") > threshold), 1.0).otherwise(0.0),
            "valid": col("y_ret").isNotNull() & col("sigma").isNotNull() & yes(col("__gap") <= max_gap) & yes(F.abs("y_ret") <= extreme),
        }
    ).drop("__ret", "__exit", "__gap", "__sd")


def weights(rows: DataFrame, horizon: int = 1, halflife: float = 756.0) -> DataFrame:
    """Uniqueness times age decay times size of move, with mean one for each symbol."""
    whole = w.Window.partitionBy("symbol")
    age = F.datediff(F.max("date").over(whole), "date")
    size = F.abs("y_ret") / F.greatest(F.median(F.abs("y_ret")).over(whole), F.lit(1e-8))
    raw = F.lit(1.0 / max(1, horizon)) * F.exp(-math.log(2.0) * age / halflife) * F.coalesce(w.clip(size, 0.25, 4.0), F.lit(1.0))
    return rows.withColumn("__w", raw).withColumn("weight", col("__w") / F.avg("__w").over(whole)).drop("__w")


def walk_forward(n: int, folds: int = 8, purge: int = 2, embargo: int = 5, least_train: int = 500, anchored: bool = True, train_rows: int = 1500) -> list[tuple[int, int, int, int, int]]:
    """(fold, train_lo, train_hi, test_lo, test_hi), half-open row positions; test slices end at n.

    Training ends purge + embargo rows before its test slice; a fold with too little training is left out.
    """
    size = (n - least_train) // folds
    out = []
    for k in range(folds if size > 0 else 0):
        lo = least_train + k * size
        hi = n if k == folds - 1 else lo + size
        end = lo - purge - embargo
        start = 0 if anchored else max(0, end - train_rows)
        if end - start >= least_train // 2:
            out.append((k, start, end, lo, hi))
    return out


def splits(rows: DataFrame, folds: int = 8, purge: int = 2, embargo: int = 5, least_train: int = 500, anchored: bool = True, train_rows: int = 1500) -> DataFrame:
    """(symbol, fold, train_lo, train_hi, test_lo, test_hi) by each symbol's number of rows: walk_forward as columns."""
    size = F.floor((col("n") - least_train) / folds)
    made = rows.groupBy("symbol").agg(F.count("*").alias("n")).withColumn("__size", size).where(col("__size") > 0)
    made = made.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold")).withColumn("test_lo", least_train + col("fold") * col("__size"))
    made = made.withColumns({"test_hi": F.when(col("fold") == folds - 1, col("n")).otherwise(col("test_lo") + col("__size")), "train_hi": col("test_lo") - purge - embargo})
    made = made.withColumn("train_lo", F.lit(0) if anchored else F.greatest(F.lit(0), col("train_hi") - train_rows))
    return made.where(col("train_hi") - col("train_lo") >= least_train // 2).select("symbol", "fold", *[col(c).cast("long").alias(c) for c in ("train_lo", "train_hi", "test_lo", "test_hi")])


def membership(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with fold and role (train or test), by row position within the symbol: each row meets the few splits of its symbol."""
    placed = rows.withColumn("__rn", (F.row_number().over(w.series()) - 1).cast("long"))
    joined = placed.join(parts, "symbol")
    role = F.when(col("__rn").between(col("train_lo"), col("train_hi") - 1), "train").when(col("__rn").between(col("test_lo"), col("test_hi") - 1), "test")
    return joined.withColumn("role", role).where(col("role").isNotNull()).drop("__rn", "train_lo", "train_hi", "test_lo", "test_hi")
