"""Quantile regression, sketches, and forecasts that may not see later rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import sketches
from tidemark.operators import features, models, quantiles, trust
from tidemark.sources import files


def loss(y, q, level):
    return float(np.where(y >= q, level * (y - q), (level - 1) * (y - q)).mean())


def test_quantile_fits_are_as_good_as_a_search(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, spread in (("a", 1.0), ("b", 0.01)):
        x = rng.uniform(0.5, 2, 800)
        rows += [(g, float(v), float(spread * (0.3 * v + v * e))) for v, e in zip(x, rng.standard_normal(800))]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 1.0, None)], "g string, x double, y double")
    fitted = quantiles.fit(df, ["x"], ["g"], "y", rounds=60)
    for g in ("a", "b"):
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        for (c, d), level in zip(fitted[(g,)], quantiles.LEVELS):
            mine, scale = loss(y, c + d * x, level), float(np.abs(y).mean())
            best = min(loss(y, c + a * scale + (d + b * scale) * x, level) for a in np.linspace(-0.3, 0.3, 31) for b in np.linspace(-0.3, 0.3, 31))
            assert mine <= best * 1.002
            assert abs(float((y <= c + d * x).mean()) - level) < 0.01
    again = quantiles.fit(df.repartition(5), ["x"], ["g"], "y", rounds=60)
    assert np.allclose(again[("a",)], fitted[("a",)], rtol=1e-6, atol=1e-9)


def test_forecasts_never_cross_and_tell_what_they_lack(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", -3.0, 0.5), ("a", None, 0.0), ("z", 1.0, 0.0)], "g string, x double, y double")
    made = quantiles.forecasts(df, {("a",): [[0.0, 1.0], [0.5, 0.0], [1.0, -1.0]]}, ["x"], ["g"]).collect()
    for r in made:
        if r["g"] == "a" and r["x"] is not None:
            assert r["q10"] <= r["q50"] <= r["q90"]
        else:
            assert r["q10"] is None and r["q90"] is None
    q = quantiles.quality(spark.createDataFrame(made), ["g"], "y").first()
    assert q["n"] == 2 and q["coverage"] == 1.0
    assert quantiles.fit(df.limit(0), ["x"], ["g"], "y") == {}
    flat = spark.createDataFrame([("a", 1.0, 0.0), ("a", 2.0, 0.0)], df.schema)
    assert quantiles.fit(flat, ["x"], ["g"], "y")[("a",)] == [[0.0, 0.0]] * 3


def test_sketches_are_exact_while_small_and_close_when_large(spark):
    rng = random.Random(2)
    small = [rng.gauss(0, 1) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in small] + [(None,), (float("nan"),)], "x double").repartition(7)
    got = df.agg(sketches.sketch("x").alias("s")).select(sketches.quantiles(F.col("s"), [0, 0.001, 0.1, 0.5, 0.999, 1]).alias("q")).first()["q"]
    assert got == np.quantile(small, [0, 0.001, 0.1, 0.5, 0.999, 1], method="inverted_cdf").tolist()
    assert df.where("x IS NULL").agg(sketches.sketch("x").alias("s")).select(sketches.quantile(F.col("s"), 0.5).alias("q")).first()["q"] is None
    n = 400_000
    large = spark.range(n).select(F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x")).repartition(16)
    at = [0.001, 0.25, 0.5, 0.9, 0.999]
    got = large.agg(sketches.sketch("x").alias("s"), F.octet_length(sketches.sketch("x")).alias("size")).select("size", sketches.quantiles(F.col("s"), at).alias("q")).first()
    # The stated rank error, as a share of all rows, and a size that has nothing to do with n.
    assert max(abs(v / n - q) for v, q in zip(got["q"], at)) <= 1.7 * sketches.DETAIL**-0.9 and got["size"] < 300_000


def test_no_exact_percentile_over_a_whole_fold(spark):
    df = spark.createDataFrame([(0, float(k), float(k % 7)) for k in range(50)], "fold int, a double, b double")
    plan = models.preparation(df, ["a", "b"])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "kll" in plan.lower()
    fitted = models.preparation(df, ["a", "b"]).first()
    assert fitted["__a"]["mid"] == 24.0 and fitted["__b"]["mid"] == 3.0
    assert features.winsorised(df, ["a"], 1.0).agg(F.max("a")).first()[0] == pytest.approx(24.0 + np.std(range(50)))


HAR = "symbol string, fold int, har_d double, har_w double, har_m double, log_rv_next double"


def har_rows(seed=9, n=200):
    rng = random.Random(seed)
    return [("S", 0, *(d := (rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1))), 0.5 + 0.4 * d[0] + 0.3 * d[1] - 0.2 * d[2]) for _ in range(n)]


def test_forecasts_do_not_change_with_other_test_rows(spark):
    train = spark.createDataFrame(har_rows(), HAR)
    gap, late = ("S", 0, None, 0.1, 0.2, 0.0), [("S", 0, 50.0 + k, 9.0, 9.0, 9.0) for k in range(30)]
    predict = lambda rows: models.har_predict(spark.createDataFrame(rows, HAR), models.har_ols(train), train.select("symbol", "har_d", "har_w", "har_m")).where("har_d IS NULL").first()["har"]
    assert predict([gap]) == predict([gap, *late])


def test_har_equations_compile(spark):
    """Generated code of the regression and of what follows it stays within the limits of one method; falling back is an error here."""
    train = spark.createDataFrame(har_rows(), HAR)
    before = {k: spark.conf.get(k) for k in ("spark.sql.codegen.fallback", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
        made = models.har_predict(train, models.har_ols(train, keys=["symbol", "fold"]).drop("fold"), train)
        score = trust.forecast_scores(made.withColumn("mu", F.lit(0.5)), "log_rv_next", "har", "mu", ["symbol"]).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert score["r2_oos"] == pytest.approx(1.0)
    singular = spark.createDataFrame([("T", 0, 1.0, 1.0, 1.0, 1.0)] * 3, HAR)
    assert models.har_ols(singular).first()["day"] is None


def test_market_keeps_the_last_bar_of_a_day(spark, tmp_path):
    rows = spark.createDataFrame([("S", "2020-01-01", 1.0), ("S", "2020-01-01", 3.0), ("S", "2020-01-01", 2.0)], "symbol string, date string, close double").coalesce(1)
    rows.write.parquet(str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert files.market(read, ["S"], [])[0].first()["close"] == 2.0
    assert files.market(rows, ["S"], [])[0].first()["close"] == 3.0
    assert files.market(rows.withColumn("seq", -F.col("close")), ["S"], [], "seq")[0].first()["close"] == 1.0
