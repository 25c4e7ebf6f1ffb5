"""The ridge path against refits, one penalty and one left-out row at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ridge


def data(n=60, k=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, [1, 10, 0.1, 2], (n, k)) + 5
    x[:, 3] = x[:, 0] + 0.01 * rng.normal(size=n)  # nearly collinear
    return x, x @ np.array([0.5, -0.02, 3.0, 0.0]) + rng.normal(0, 0.5, n)


def direct(x, y, alpha):
    mx, sd, my = x.mean(0), x.std(0), y.mean()
    z = (x - mx) / sd
    b = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - my))
    hat = z @ np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T)
    rss, left = float(((y - my - z @ b) ** 2).sum()), len(y) - 1 - np.trace(hat)
    return (my - (b / sd) @ mx, *(b / sd)), len(y) * rss / left**2


NAMES = ["a", "b", "c", "d"]


def test_every_penalty_is_what_a_refit_gives(spark):
    sets = {g: data(seed=g) for g in (1, 2)}
    rows = [(g, *map(float, r), float(v)) for g, (x, y) in sets.items() for r, v in zip(x, y)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0, None), (3, 1.0, 1.0, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, d double, y double").repartition(5)
    fitted = ridge.paths(df, NAMES, ["g"], "y")
    assert set(fitted) == {(1,), (2,)} and len(ridge.ALPHAS) == 30
    for g, (x, y) in sets.items():
        path = fitted[(g,)]
        for a, score, b in zip(path.alphas, path.scores, path.coefficients):
            want, gcv = direct(x, y, a)
            assert score == pytest.approx(gcv, rel=1e-6) and b == pytest.approx(want, rel=1e-5, abs=1e-7)
        assert path.best == int(np.argmin(path.scores))
    shown = df.where("g = 2 AND y IS NOT NULL").select("*", ridge.predicted(F.array(*NAMES), [F.col("g")], fitted).alias("p")).collect()
    for r in shown:
        b = fitted[(2,)].chosen
        assert r["p"] == pytest.approx(b[0] + sum(v * r[c] for v, c in zip(b[1:], NAMES)))
    assert df.where("g = 3").select(ridge.predicted(F.array(*NAMES), [F.col("g")], fitted).alias("p")).first()["p"] is None


def test_features_without_spread_and_noise(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(0, 7.0, float(rng.normal()), float(rng.normal())) for _ in range(80)], "g int, a double, b double, y double")
    path = ridge.paths(df, ["a", "b"], ["g"], "y")[(0,)]
    assert all(c[1] == 0.0 for c in path.coefficients)
    assert abs(path.coefficients[-1][2]) < abs(path.coefficients[0][2]) + 1e-12 and path.best > 10
    assert ridge.paths(df.limit(0), ["a", "b"], ["g"], "y") == {}
