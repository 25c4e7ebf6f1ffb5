"""Calibrating scores and weighing models, for all folds at once.

Scores are counted by (fold, block, bin) first, so that what reaches the driver has a bound: BINS rows for each
block, however many scores there are. Curves are fitted to these counts there and come back as columns. Logistic
regressions over few features are fitted by Newton steps whose sums are one aggregate for all groups together.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

col = F.col
BINS, LOW, HIGH = 512, 1e-6, 1 - 1e-6


def clipped(p: Column) -> Column:
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.coalesce(F.nanvl(p, F.lit(0.5)), F.lit(0.5))))


def logit(p: Column) -> Column:
    safe = clipped(p)
    return F.ln(safe / (1 - safe))


def grouped_logit(
    rows: DataFrame, names: list[str], keys: list[str], y: str = "y_cls", weight: str | None = None, l2: float = 1.0, rounds: int = 12, tolerance: float = 1e-6
) -> dict[tuple, np.ndarray]:
    """Group -> (intercept, one coefficient for each name) of logistic regressions, the coefficients shrunk by l2 / 2 * sum of squares.

    Newton steps: one aggregate a step for all groups, of which the driver solves the small equations. For few
    names, as there are (k + 1)^2 / 2 sums; the groups must be few enough for a small table.
    """
    terms = [F.lit(1.0), *[col(n).cast("double") for n in names]]
    k = len(terms)
    live = rows.where(col(y).isNotNull()).select(*keys, col(y).cast("double").alias("__y"), (col(weight) if weight else F.lit(1.0)).alias("__w"), F.array(*terms).alias("__x"))
    beta: dict[tuple, np.ndarray] = {}
    for step in range(rounds):
        at = lambda i: F.get("__x", F.lit(i))
        if not step:
            now, p = live, F.lit(0.5)
        else:
            made = [(*g, b.tolist()) for g, b in beta.items()]
            known = rows.sparkSession.createDataFrame(made, T.StructType([*live.select(*keys).schema.fields, T.StructField("__b", T.ArrayType(T.DoubleType()))]))
            now = live.join(F.broadcast(known), keys) if keys else live.join(F.broadcast(known))
            p = 1 / (1 + F.exp(-F.aggregate(F.zip_with("__x", "__b", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))
        now = now.withColumn("__p", p)
        h, g = col("__w") * col("__p") * (1 - col("__p")), col("__w") * (col("__y") - col("__p"))
        sums = [F.sum(h * at(i) * at(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(g * at(i)).alias(f"g{i}") for i in range(k)]
        moved = 0.0
        for r in now.groupBy(*keys).agg(*sums).collect():
            group = tuple(r[c] for c in keys)
            if r["g0"] is None:
                continue
            old = beta.get(group, np.zeros(k))
            shrink = np.diag([1e-9, *[l2] * (k - 1)])
            hessian = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + shrink
            new = old + np.linalg.lstsq(hessian, np.array([r[f"g{i}"] for i in range(k)]) - shrink @ old, rcond=None)[0]
            moved = max(moved, float(np.abs(new - old).max()))
            beta[group] = new
        if moved < tolerance:
            break
    return beta


def stacking_weights(rows: DataFrame, probabilities: list[str], keys: list[str], y: str = "y_cls", least: int = 30) -> dict[tuple, list[float]]:
    """Group -> weights of the models, none negative, with sum one: logistic regression on the models' log odds.

    A group of fewer than `least` rows, or one in which no model helps, weighs all alike.
    """
    logits = [f"__l{k}" for k in range(len(probabilities))]
    live = rows.withColumns({z: logit(col(p)) for z, p in zip(logits, probabilities)})
    sizes = {tuple(r[c] for c in keys): r["n"] for r in live.groupBy(*keys).agg(F.count(y).alias("n")).collect()}
    fitted = grouped_logit(live, logits, keys, y) if len(probabilities) > 1 else {}
    out = {}
    for group, n in sizes.items():
        w = np.clip(fitted.get(group, np.zeros(len(probabilities) + 1))[1:], 0, None)
        even = n < least or w.sum() <= 1e-9
        out[group] = [1 / len(probabilities)] * len(probabilities) if even else (w / w.sum()).tolist()
    return out


@dataclass(frozen=True)
class Calibrator:
    """none: p as it is; platt: a + b * p through the logistic; isotonic: rising steps, joined by lines."""

    kind: str = "none"
    a: float = 0.0
    b: float = 1.0
    x: tuple[float, ...] = ()
    z: tuple[float, ...] = ()

    def at(self, p: np.ndarray) -> np.ndarray:
        if self.kind == "platt":
            q = 1 / (1 + np.exp(-(self.a + self.b * p)))
        else:
            q = np.interp(p, self.x, self.z) if self.kind == "isotonic" else p
        return np.clip(q, LOW, HIGH)

    def column(self, p: Column) -> Column:
        if self.kind == "platt":
            return clipped(1 / (1 + F.exp(-(self.a + self.b * p))))
        if self.kind == "none":
            return clipped(p)
        xs, zs = (F.array(*[F.lit(float(v)) for v in values]) for values in (self.x, self.z))
        k = F.size(F.filter(xs, lambda v: v <= p))  # how many corners lie at or below p
        x0, x1, z0, z1 = (F.get(a, i) for a, i in ((xs, k - 1), (xs, k), (zs, k - 1), (zs, k)))
        inside = z0 + (z1 - z0) * (p - x0) / F.nullif(x1 - x0, F.lit(0.0))
        return clipped(F.when(k == 0, F.lit(float(self.z[0]))).when(k == len(self.x), F.lit(float(self.z[-1]))).otherwise(F.coalesce(inside, z0)))


def counted(scores: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, bin, n, pos, mean_p) of scores(y, p): all that the curves below are fitted to."""
    b = F.least(F.floor(col("p") * bins), F.lit(bins - 1)).cast("int")
    return scores.where("y IS NOT NULL AND p IS NOT NULL").groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.sum(col("y").cast("double")).alias("pos"), F.avg("p").alias("mean_p"))


def platt(points: list[tuple[float, float, float]], l2: float = 1.0) -> Calibrator:
    """points: (mean p, rows, of them positive)."""
    p, n, pos = (np.array(c, float) for c in zip(*points))
    x, beta = np.column_stack((np.ones(len(p)), p)), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(x @ beta)))
        shrink = np.diag([0.0, l2])
        step = np.linalg.lstsq(x.T @ (x * (n * q * (1 - q))[:, None]) + shrink, x.T @ (pos - n * q) - shrink @ beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return Calibrator("platt", float(beta[0]), float(beta[1]))


def isotonic(points: list[tuple[float, float, float]], low: float = 0.02, high: float = 0.98) -> Calibrator:
    """Rates that never fall as p rises, by merging neighbours that do, within low and high."""
    merged: list[list[float]] = []  # weight, rate, first p, last p
    for p, n, pos in sorted(points):
        merged.append([n, pos / n, p, p])
        while len(merged) > 1 and merged[-2][1] >= merged[-1][1]:
            b, a = merged.pop(), merged.pop()
            merged.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2], b[3]])
    x = [v for m in merged for v in ((m[2], m[3]) if m[3] > m[2] else (m[2],))]
    z = [min(high, max(low, m[1])) for m in merged for _ in range(2 if m[3] > m[2] else 1)]
    return Calibrator("isotonic", x=tuple(x), z=tuple(z))


def fitted(points: list[tuple[float, float, float]], kind: str, least: int = 40) -> Calibrator:
    n, pos = sum(p[1] for p in points), sum(p[2] for p in points)
    if kind == "none" or n < least or pos in (0, n):
        return Calibrator()
    return {"platt": platt, "isotonic": isotonic}[kind](points)


def chosen(blocks: dict[int, list[tuple[float, float, float]]], least: int = 60, least_block: int = 15) -> Calibrator:
    """The kind with the least log loss on blocks it was not fitted on, fitted on all of them."""
    every = [p for b in blocks.values() for p in b]
    n, pos = sum(p[1] for p in every), sum(p[2] for p in every)
    if n < least or pos in (0, n):
        return Calibrator()
    loss = {}
    for kind in ("none", "platt", "isotonic"):
        seen = []
        for k, held in blocks.items():
            rest = [p for j, b in blocks.items() if j != k for p in b]
            size, hits = sum(p[1] for p in held), sum(p[2] for p in held)
            if size < least_block or hits in (0, size) or sum(p[2] for p in rest) in (0, sum(p[1] for p in rest)):
                continue
            p, m, y = (np.array(c, float) for c in zip(*held))
            q = fitted(rest, kind).at(p)
            seen.append(float(-(y * np.log(q) + (m - y) * np.log(1 - q)).sum() / m.sum()))
        loss[kind] = sum(seen) / len(seen) if seen else math.inf
    best = min(loss, key=loss.get)
    return fitted(every, best) if math.isfinite(loss[best]) else Calibrator()


def by_group(scores: DataFrame, keys: list[str], kind: str | None = None) -> dict[tuple, Calibrator]:
    """Group -> calibrator of scores(y, p, block): of one kind, or the one that holds up best over the blocks."""
    groups: dict[tuple, dict[int, list]] = {}
    for r in counted(scores, [*keys, "block"]).orderBy(*keys, "block", "bin").collect():
        groups.setdefault(tuple(r[c] for c in keys), {}).setdefault(r["block"], []).append((r["mean_p"], r["n"], r["pos"]))
    if kind is None:
        return {g: chosen(b) for g, b in groups.items()}
    return {g: fitted([p for rows in b.values() for p in rows], kind) for g, b in groups.items()}


def applied(p: Column, fold: Column, calibrators: dict[tuple, Calibrator]) -> Column:
    """p through the calibrator of its fold; p itself where the fold has none."""
    out = None
    for (k,), c in sorted(calibrators.items()):
        out = F.when(fold == k, c.column(p)) if out is None else out.when(fold == k, c.column(p))
    return clipped(p) if out is None else out.otherwise(clipped(p))
