"""Ridge regression for a whole path of penalties from one pass: the Gram matrix of each group, its eigenvectors, and for every
penalty the generalised cross-validation score, without a refit and without a second look at the rows.

With the features centred and scaled, G = X'X = V diag(d) V' and c = V'X'y give for a penalty a the coefficients
V c / (d + a), the residual sum yy - sum(c * c * (d + 2 a) / (d + a) ** 2) and the degrees of freedom sum(d / (d + a)). The sums are one aggregate
for all groups; what reaches the driver are (k + 2)(k + 3) / 2 numbers for each group of k features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

col = F.col
#: 30 penalties, even in their logarithm.
ALPHAS = tuple(float(a) for a in np.logspace(-3, 4, 30))


@dataclass(frozen=True)
class Path:
    """One group's path: scores and coefficients (intercept first) for each penalty; best is the place of the least score."""

    n: int
    alphas: tuple[float, ...]
    scores: tuple[float, ...]
    coefficients: tuple[tuple[float, ...], ...]
    best: int

    @property
    def chosen(self) -> tuple[float, ...]:
        return self.coefficients[self.best]


def _path(n: int, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray, syy: float, alphas: tuple[float, ...]) -> Path:
    mx, my = sx / n, sy / n
    gram, xy, yy = sxx - n * np.outer(mx, mx), sxy - n * mx * my, max(0.0, syy - n * my * my)
    sd = np.sqrt(np.maximum(np.diag(gram) / n, 0))
    used = sd > 1e-12
    scale = np.where(used, sd, 1.0)
    gram, xy = np.where(np.outer(used, used), gram / np.outer(scale, scale), 0.0), np.where(used, xy / scale, 0.0)
    d, v = np.linalg.eigh(gram)
    d = np.maximum(d, 0)
    c = v.T @ xy
    scores, made = [], []
    for a in alphas:
        rss = max(0.0, yy - float((c * c * (d + 2 * a) / (d + a) ** 2).sum()))
        left = n - 1 - float((d / (d + a)).sum())
        scores.append(n * rss / left**2 if left > 0 else float("inf"))
        b = (v @ (c / (d + a))) / scale
        made.append((float(my - b @ mx), *map(float, b)))
    return Path(n, alphas, tuple(scores), tuple(made), int(np.argmin(scores)))


def paths(rows: DataFrame, names: list[str], keys: list[str], y: str, alphas: tuple[float, ...] = ALPHAS) -> dict[tuple, Path]:
    """Group -> Path of y on the features. Rows that lack y or a feature take no part; a group of fewer than three rows is absent.

    A feature without spread has coefficient zero. Penalties are those of centred features of unit variance; of penalties
    with equal scores the smallest is chosen.
    """
    k = len(names)
    full = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in (y, *names)))
    terms = [F.lit(1.0), *[col(c).cast("double") for c in names], col(y).cast("double")]
    sums = [F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    out = {}
    for r in full.groupBy(*keys).agg(*sums).collect():
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(k + 2)] for i in range(k + 2)], float)
        if g[0, 0] >= 3:
            out[tuple(r[c] for c in keys)] = _path(int(g[0, 0]), g[0, 1 : k + 1], g[1 : k + 1, 1 : k + 1], g[0, k + 1], g[1 : k + 1, k + 1], g[k + 1, k + 1], alphas)
    return out


def predicted(x: Column, group: list[Column], fitted: dict[tuple, Path]) -> Column:
    """The chosen fit's forecast from an array of features; null where the group has no fit. The groups must be few."""
    out = F.lit(None).cast("double")
    for key, path in sorted(fitted.items(), key=str):
        b = F.array(*[F.lit(v) for v in path.chosen[1:]])
        made = path.chosen[0] + F.aggregate(F.zip_with(x, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
        same = F.lit(True)
        for c, v in zip(group, key):
            same = same & (c == F.lit(v))
        out = F.when(same, made).otherwise(out)
    return out
