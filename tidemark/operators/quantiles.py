"""Linear quantile regression for all groups and levels at once, and forecasts whose quantiles never cross.

The pinball loss is smoothed within `smooth` of each group's mean |y| and majorised by a parabola that touches it at the residual
of the step before. Minimising the parabola is weighted least squares with weights 1 / (eps + |residual|), shifted by
(2 * level - 1): its sums over all rows are one aggregate a step, for every (group, level) together, and what reaches
the driver are these sums. Each step lowers the smoothed loss, so the order of rows and how they lie in files don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

col = F.col
LEVELS = (0.1, 0.5, 0.9)


def _dot(x: str, b: str) -> Column:
    return F.aggregate(F.zip_with(x, b, lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c)


def fit(
    rows: DataFrame, names: list[str], keys: list[str], y: str = "y_ret", levels: tuple[float, ...] = LEVELS, weight: str | None = None, rounds: int = 40, smooth: float = 0.01, tolerance: float = 1e-6
) -> dict[tuple, list[list[float]]]:
    """Group -> for each level (intercept, one coefficient for each name).

    Rows that lack y or a feature take no part; a group without rows is absent, and one whose y never moves away from
    zero has zeros. For few names, as there are (k + 1)(k + 4) / 2 sums for each group and level.
    """
    spark = rows.sparkSession
    k = len(names) + 1
    full = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (y, *names)))
    live = full.select(*keys, col(y).cast("double").alias("__y"), (col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"), F.array(F.lit(1.0), *[col(n).cast("double") for n in names]).alias("__x"))
    scale = {tuple(r[c] for c in keys): r["m"] for r in live.groupBy(*keys).agg(F.avg(F.abs("__y")).alias("m")).collect()}
    shape = T.StructType([*live.select(*keys).schema.fields, T.StructField("__l", T.IntegerType()), T.StructField("__t", T.DoubleType()), T.StructField("__e", T.DoubleType()), T.StructField("__b", T.ArrayType(T.DoubleType()))])
    beta = {(g, j): np.zeros(k) for g in scale for j in range(len(levels))}
    going = {p for p in beta if scale[p[0]] > 0}
    at = lambda i: F.get("__x", F.lit(i))
    for _ in range(rounds):
        if not going:
            break
        # One row for each group and level.
        known = spark.createDataFrame([(*g, j, levels[j], smooth * scale[g], beta[g, j].tolist()) for g, j in sorted(going, key=str)], shape)
        now = live.join(F.broadcast(known), keys) if keys else live.join(F.broadcast(known))
        now = now.withColumn("__v", col("__w") / (col("__e") + F.abs(col("__y") - _dot("__x", "__b"))))
        tilt = col("__w") * (2 * col("__t") - 1)
        sums = [F.sum(col("__v") * at(i) * at(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        sums += [F.sum((col("__v") * col("__y") + tilt) * at(i)).alias(f"g{i}") for i in range(k)]
        for r in now.groupBy(*keys, "__l").agg(*sums).collect():
            p = (tuple(r[c] for c in keys), r["__l"])
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            size = np.sqrt(np.maximum(np.diag(h), 1e-300))
            new = np.linalg.lstsq(h / np.outer(size, size), np.array([r[f"g{i}"] for i in range(k)]) / size, rcond=None)[0] / size
            if np.abs((new - beta[p]) * size).max() <= tolerance * max(1e-300, float(np.abs(new * size).max())):
                going.discard(p)
            beta[p] = new
    return {g: [beta[g, j].tolist() for j in range(len(levels))] for g in scale}


def forecasts(rows: DataFrame, fitted: dict[tuple, list[list[float]]], names: list[str], keys: list[str], levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """rows plus q10, q50, q90 (a name for each level), in rising order whatever the fits say; null where a feature is missing or the group has no fit."""
    shape = T.StructType([*rows.select(*keys).schema.fields, T.StructField("__bs", T.ArrayType(T.ArrayType(T.DoubleType())))])
    known = rows.sparkSession.createDataFrame([(*g, b) for g, b in fitted.items()], shape)
    joined = rows.join(F.broadcast(known), keys, "left") if keys else rows.join(F.broadcast(known), how="left")  # one row for each group
    x = F.array(F.lit(1.0), *[col(n).cast("double") for n in names])
    raw = F.transform("__bs", lambda b: F.aggregate(F.zip_with(x, b, lambda a, c: a * c), F.lit(0.0), lambda a, c: a + c))
    ready = joined.withColumn("__q", F.when(~F.exists(x, lambda v: v.isNull()), F.array_sort(raw)))
    order = {v: i for i, v in enumerate(sorted(levels))}
    return ready.withColumns({f"q{round(100 * v)}": F.get("__q", F.lit(order[v])) for v in levels}).drop("__bs", "__q")


def pinball(y: Column, q: Column, level: float) -> Column:
    return F.when(y >= q, level * (y - q)).otherwise((level - 1) * (y - q))


def quality(rows: DataFrame, keys: list[str], y: str = "y_ret", levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(keys, n, coverage, width, loss_*): how often y lies between the outer quantiles, how far these are apart, and each level's mean pinball loss."""
    name = lambda v: f"q{round(100 * v)}"
    low, high = name(min(levels)), name(max(levels))
    live = rows.where(f"{y} IS NOT NULL AND {low} IS NOT NULL")
    return live.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(col(y).between(col(low), col(high)).cast("double")).alias("coverage"), F.avg(col(high) - col(low)).alias("width"),
        *[F.avg(pinball(col(y), col(name(v)), v)).alias(f"loss_{name(v)}") for v in levels],
    )
