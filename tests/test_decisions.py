"""Guards, verdicts, calibration, training on signal and on noise, stored models, the command line and the clock."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import anchoring, backtest, blocks, calibration, guards, labels, models, trust, tuning, verdicts
from tidemark.sources import files
from tidemark.streaming import clock, quotes

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def walk(n, seed, symbol="S"):
    rng, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        o = price * (1 + rng.gauss(0, 0.004))
        c = o * (1 + rng.gauss(0, 0.01))
        rows.append((symbol, dt.date(2015, 1, 1) + dt.timedelta(days=k), o, max(o, c) * 1.002, min(o, c) * 0.998, c, 1e6 * math.exp(rng.gauss(0, 0.3))))
        price = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(420, 1) + walk(380, 2, "T"), SCHEMA)


def test_bar_guard_names_what_is_wrong(spark, bars):
    assert guards.require_valid(bars) is bars
    bad = {
        "few_rows": bars.where("symbol = 'S'").limit(20), "repeated_dates": bars.unionByName(bars.limit(1)), "not_positive": bars.withColumn("open", F.when(F.col("date") == "2015-03-01", -1.0).otherwise(F.col("open"))),
        "high_below_low": bars.withColumn("high", F.when(F.col("date") == "2015-03-01", 1.0).otherwise(F.col("high"))),
    }
    for name, table in bad.items():
        with pytest.raises(guards.DataIntegrityError, match=name):
            guards.require_valid(table)
    soft = bars.withColumn("volume", F.when(F.col("date") < "2015-06-01", 0.0).otherwise(F.col("volume"))).where("date NOT BETWEEN '2015-08-01' AND '2015-09-01'")
    assert {tuple(r["warnings"]) for r in guards.report(soft).collect()} == {("no_volume", "gaps")}


def test_feature_guards(bars):
    rows = labels.build(bars).withColumn("leak", F.col("y_ret") * 0.9)
    guards.require_no_leak(rows, ["volume"])
    with pytest.raises(guards.LeakageError, match="leak"):
        guards.require_no_leak(rows, ["volume", "leak"])
    with pytest.raises(guards.DataIntegrityError, match="nothing"):
        guards.require_columns(rows, ["close", "nothing"])
    guards.require_finite(rows, ["close"])
    for value in (None, float("nan"), float("inf")):
        with pytest.raises(guards.DataIntegrityError, match="close"):
            guards.require_finite(rows.withColumn("close", F.when(F.col("date") == "2015-03-01", F.lit(value).cast("double")).otherwise(F.col("close"))), ["open", "close"])
    parts = labels.splits(bars, folds=3, least_train=200)
    assert parts.count() == 6 and guards.require_no_overlap(parts, 8) is parts
    with pytest.raises(guards.LeakageError):
        guards.require_no_overlap(parts, 9)
    for n in (420, 380):
        want = labels.walk_forward(n, folds=3, least_train=200)
        assert [tuple(r)[1:] for r in parts.where(F.col("symbol") == ("S" if n == 420 else "T")).orderBy("fold").collect()] == want


def test_stale_quotes_stop(spark):
    now = dt.datetime(2020, 1, 2, 20, 0)
    rows = spark.createDataFrame([("a", 10.0, now - dt.timedelta(minutes=5)), ("b", 10.0, now - dt.timedelta(minutes=200))], "symbol string, last double, quoted_at timestamp")
    seen = quotes.fresh(rows, now)
    guards.require_fresh(seen.where("symbol = 'a'"))
    with pytest.raises(guards.StaleQuoteError, match="b: stale"):
        guards.require_fresh(seen)


GOOD = {"n_active": 100.0, "sharpe": 1.0, "sharpe_overlap_adj": 0.9, "auc": 0.55, "directional_accuracy": 0.56, "base_rate": 0.53, "hold_sharpe": 0.5, "pbo": 0.1, "deflated": 0.95, "p_sharpe": 0.01, "share_positive": 0.8, "skill": 0.01, "continuous_n": 100.0, "continuous_sharpe": 0.9, "stress_p05": 0.1}


def decided(spark, changes):
    row = GOOD | changes
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
    return verdicts.decide(df, verdicts.trading_checks()).first()


@pytest.mark.parametrize(
    "changes, verdict, n_critical",
    [
        ({}, "GO", 11), ({"skill": -1.0}, "GO", 11), ({"sharpe_overlap_adj": None}, "GO", 11), ({"n_active": 59.0}, "REVISE", 11), ({"auc": None, "p_sharpe": 0.05}, "REVISE", 11),
        ({"auc": 0.5, "p_sharpe": 0.5, "deflated": 0.5}, "NO-GO", 11), ({"pbo": None}, "GO", 10), ({"base_rate": None, "hold_sharpe": None, "stress_p05": None, "continuous_n": 5.0}, "GO", 7),
        ({"hold_sharpe": 0.95}, "REVISE", 11), ({"directional_accuracy": 0.534}, "REVISE", 11), ({"continuous_sharpe": 0.5}, "REVISE", 11), ({"continuous_sharpe": 0.2, "sharpe": None}, "REVISE", 11),
    ],
)
def test_trading_verdict(spark, changes, verdict, n_critical):
    got = decided(spark, changes)
    assert (got["verdict"], got["n_critical"]) == (verdict, n_critical)


def test_volatility_verdict(spark):
    fine = {"r2_mean": 0.2, "r2_har": 0.02, "dm": -2.5, "dm_p": 0.01, "qlike": 0.1, "qlike_har": 0.2, "mz_beta": 2.0, "share_better": 0.7}
    for changes, want in (({}, "GO"), ({"dm": 2.5}, "REVISE"), ({"dm_p": None, "r2_har": -0.1}, "NO-GO")):
        row = fine | changes
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} double" for c in row))
        assert verdicts.decide(df, verdicts.volatility_checks(), 1).first()["verdict"] == want


def test_diebold_mariano_edges(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    rng = random.Random(1)
    rows = [("few", day(k), rng.gauss(1, 1)) for k in range(29)] + [("many", day(k), rng.gauss(-0.5, 1)) for k in range(60)] + [("gap", day(k), None if k % 2 else rng.gauss(0, 1)) for k in range(80)]
    got = {r["symbol"]: r for r in trust.with_normal_p(trust.diebold_mariano(spark.createDataFrame(rows, "symbol string, date date, d double")), "dm", "p").collect()}
    assert got["few"]["dm"] is None and got["few"]["p"] is None and got["gap"]["n"] == 40
    d = np.array([r[2] for r in rows if r[0] == "many"])
    c, lag = d - d.mean(), int(1.5 * 60 ** (1 / 3))
    var = (c @ c + sum(2 * (1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, lag + 1))) / 60
    z = d.mean() / math.sqrt(var / 60)
    assert got["many"]["dm"] == pytest.approx(z) and got["many"]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_auc_over_partitions(spark):
    rng = random.Random(3)
    rows = [(k % 3, rng.randint(0, 1), round(rng.random(), 2)) for k in range(600)] + [(7, 1, 0.5), (0, None, 0.5), (0, 1, None)]
    df = spark.createDataFrame(rows, "g int, y int, p double").repartition(5)
    got = {r["g"]: r["auc"] for r in trust.auc(df, ["g"]).collect()}
    for g in (0, 1, 2):
        pos, neg = ([p for a, y, p in rows if a == g and y == k and p is not None] for k in (1, 0))
        assert got[g] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    assert got[7] is None


def test_permutation_p(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("a", None, 2.0), ("a", 2.0, 2.0)], "k string, x double, o double")
    assert trust.permutation_p(df, "o", ["k"]).first()["p_value"] == pytest.approx(3 / 4)
    assert trust.permutation_p(df, "o", ["k"], higher=False).first()["p_value"] == pytest.approx(3 / 4)


def test_grouped_logit_equals_spark_ml(spark):
    rng = random.Random(5)
    rows = []
    for g in (0, 1):
        for _ in range(400):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((g, a, b, float(rng.random() < 1 / (1 + math.exp(-(0.3 + (1 + g) * a - 0.5 * b))))))
    df = spark.createDataFrame(rows, "g int, a double, b double, y_cls double")
    got = calibration.grouped_logit(df, ["a", "b"], ["g"], l2=0.0)
    for g in (0, 1):
        own = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.where(F.col("g") == g))
        model = LogisticRegression(featuresCol="x", labelCol="y_cls", tol=1e-10, maxIter=200).fit(own)
        assert got[(g,)].tolist() == pytest.approx([model.intercept, *model.coefficients], abs=1e-4)


def test_isotonic_equals_spark_ml(spark):
    rng = random.Random(6)
    rows = [(round(rng.random(), 2), float(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame([(p, float(rng.random() < p)) for p, _ in rows], "p double, y double")
    points = [(r["mean_p"], r["n"], r["pos"]) for r in calibration.counted(df, [], 100).collect()]
    model = IsotonicRegression(featuresCol="p", labelCol="y").fit(df)
    made = calibration.isotonic(points, 0.0, 1.0)
    at = np.linspace(0, 1, 33)
    want = np.clip([model.predict(float(v)) for v in at], 1e-6, 1 - 1e-6)
    assert made.at(at) == pytest.approx(want, abs=1e-6)
    for c in (made, calibration.platt(points), calibration.Calibrator()):
        got = [r["q"] for r in spark.createDataFrame([(float(v),) for v in at], "p double").select(c.column(F.col("p")).alias("q")).collect()]
        assert got == pytest.approx(c.at(at), abs=1e-9)


def test_calibrator_choice():
    flat = lambda rate, n=200: [(k / 20, n, rate(k / 20) * n) for k in range(1, 20)]
    parts = lambda rate: {b: flat(rate) for b in range(3)}
    assert calibration.chosen(parts(lambda p: p)).kind in ("none", "isotonic")
    assert calibration.chosen(parts(lambda p: 0.2 if p < 0.5 else 0.8)).kind == "isotonic"
    assert calibration.chosen({b: [(0.5, 10, 5)] for b in range(3)}).kind == "none"
    steep = calibration.chosen(parts(lambda p: 1 / (1 + math.exp(-(6 * p - 3)))))
    assert steep.kind != "none" and abs(float(steep.at(np.array([0.25]))[0]) - 1 / (1 + math.exp(1.5))) < 0.02


def test_stacking_prefers_the_model_that_knows(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(600):
        y = rng.random() < 0.5
        rows.append((0, float(y), min(0.95, max(0.05, 0.5 + (0.25 if y else -0.25) + rng.gauss(0, 0.15))), rng.random()))
    df = spark.createDataFrame(rows, "fold int, y_cls double, a double, b double")
    w = calibration.stacking_weights(df, ["a", "b"], ["fold"])[(0,)]
    assert w[0] > 0.9 and sum(w) == pytest.approx(1)
    assert calibration.stacking_weights(df.limit(10), ["a", "b"], ["fold"])[(0,)] == [0.5, 0.5]


def made_folds(spark, strength, n=420):
    rng, rows = random.Random(11), []
    for s in ("A", "B"):
        for k in range(n):
            a, b = rng.gauss(0, 1), rng.gauss(0, 1)
            ret = 0.01 * (strength * a + rng.gauss(0, 1))
            rows.append((s, dt.date(2015, 1, 1) + dt.timedelta(days=k), a, None if k % 17 == 0 else b, ret, float(ret > 0), 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, y_ret double, y_cls double, weight double")
    return labels.membership(df, labels.splits(df, folds=2, least_train=260))


def test_training_finds_a_signal_and_scores_every_fold(spark, tmp_path):
    rows = made_folds(spark, 1.0)
    out, learned = models.walk_forward(rows, ["a", "b"], ("elastic_net", "forest"), refit=True)
    out = out.persist()
    assert out.count() == rows.where("role = 'test'").count() and out.select("fold").distinct().count() == 2
    area = trust.auc(out.select(F.col("y_cls").alias("y"), F.col("prob_up").alias("p"))).first()["auc"]
    assert area > 0.7
    models.save(learned, spark, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"))
    latest = rows.drop("fold", "role", "y_ret", "y_cls", "weight").distinct()
    one, two = ({r["symbol"]: r["prob_up"] for r in models.score_latest(x, latest).collect()} for x in (learned, again))
    assert one == pytest.approx(two) and set(one) == {"A", "B"}
    with pytest.raises(guards.DataIntegrityError):
        models.score_latest(again, latest.drop("a"))
    back = models.score_latest(again, latest, back=3).collect()
    assert {r["date"] for r in back} == {dt.date(2015, 1, 1) + dt.timedelta(days=416)}
    about = json.loads(spark.read.text(str(tmp_path / "m" / "about")).first()[0]) | {"format": 1}
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(str(tmp_path / "m" / "about"))
    with pytest.raises(guards.DataIntegrityError, match="format"):
        models.load(spark, str(tmp_path / "m"))


def test_permutation_of_labels_tells_signal_from_noise(spark):
    strong, none = (
        {r["measure"]: r["p_value"] for r in models.permutation_test(made_folds(spark, k), ["a", "b"], sims=15).collect()} for k in (1.0, 0.0)
    )
    assert strong["auc"] == strong["sharpe"] == pytest.approx(1 / 16) and none["auc"] > 0.06


def test_selection_keeps_what_matters(spark):
    rng, rows = random.Random(2), []
    for k in range(900):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        rows.append(("S", dt.date(2012, 1, 1) + dt.timedelta(days=k), a, b, c, a * 0.999 + 0.001 * b, 1.0, None, float(a + 0.3 * rng.gauss(0, 1) > 0), 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double, c double, twin double, flat double, empty double, y_cls double, weight double")
    assert set(models.selected(df, ["a", "b", "c", "twin", "flat", "empty"])) in ({"a", "b", "c"}, {"twin", "b", "c"})
    assert models.selected(df, ["a", "b", "c", "flat"], most=1) == ["a"]


def test_random_settings_repeat():
    for family in (*models.FAMILIES, "perceptron"):
        one = models.sample_params(family, 5)
        assert one == models.sample_params(family, 5) != models.sample_params(family, 5, seed=8)
        assert models.estimator(family, one[0], 4) is not None


def test_normal_scores_keep_order(spark):
    df = spark.createDataFrame([(0, float(k) ** 3) for k in range(200)] + [(0, None)], "fold int, a double")
    got = [r["a"] for r in models.normal_scores(df.withColumn("k", F.monotonically_increasing_id()), ["a"]).orderBy("k").collect()]
    values = got[:200]
    assert values == sorted(values) and abs(sum(values) / 200) < 0.1 and 0.8 < np.std(values) < 1.2 and got[200] is None


def test_blocks_do_not_see_the_future(spark, bars):
    day = dt.date(2015, 12, 1)
    context = bars.where("symbol = 'T'").select(F.lit("V").alias("symbol"), "date", "close")
    build = lambda b, c: blocks.volatility_structure(blocks.cross_block(blocks.period_block(blocks.base_block(b), "week", "wk"), c, {"V": "v"}, "v"), c, "V", "V", "V", "V", "V")
    full, cut = (build(bars.where(k), context.where(k)).where(F.col("date") == day).orderBy("symbol").collect() for k in (F.lit(True), F.col("date") <= day))
    assert len(full) == 2 and len(full[0].asDict()) > 100
    for a, b in zip(full, cut):
        for name in a.asDict():
            assert a[name] == b[name] or a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-12), name


def test_command_line(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    settings = ["--set", "data.least_rows=100", "--set", "splits.folds=2", "--set", "splits.least_train=250", "--set", 'models.families=["elastic_net"]', "--set", "trust.permutations=10"]
    report = cli.main(["scan", "--bars", path, *settings], spark)
    assert report.count() == 2
    with pytest.raises(guards.DataIntegrityError):
        cli.main(["run", "--bars", path, "--out", str(tmp_path / "out")], spark)
    judged = cli.main(["run", "--bars", path, "--out", str(tmp_path / "out"), *settings], spark)
    assert {r["symbol"] for r in judged.collect()} == {"S", "T"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "run" / "oos")).count() > 100
    scored = cli.main(["predict", "--bars", path, "--models", str(tmp_path / "out"), "--symbols", "S"], spark)
    assert [r["symbol"] for r in scored.collect()] == ["S"]
    assert files.stored_models(spark, str(tmp_path / "out")).collect() == [("model", "close")]


def test_search_and_selection_feed_training(spark):
    """The planted feature is chosen in every fold and a constant one in none; the winners are what the models were made with."""
    rows = made_folds(spark, 1.0).withColumns({"flat": F.lit(1.0), "noise": F.pmod(F.xxhash64("symbol", "date"), F.lit(1000)) / 1000.0})
    names = ["a", "b", "flat", "noise"]
    out, found = tuning.tuned(rows, names, ("elastic_net", "forest"), trials=4, most=2, inner=2, refit=True)
    out = out.persist()
    assert out.count() == rows.where("role = 'test'").count() and out.where("prob_up IS NULL").count() == 0
    picks = {k: {r["feature"] for r in found.picks.where(F.col("fold") == k).collect()} for k in (0, 1)}
    assert all("a" in p and "flat" not in p and len(p) == 2 for p in picks.values())
    trials = found.trials.collect()
    assert len(trials) == 4 and set(found.best) == {"elastic_net", "forest"}
    for family, params in found.best.items():
        own = [r for r in trials if r["family"] == family and r["score"] is not None]
        assert params == json.loads(max(own, key=lambda r: (r["score"], -r["trial"]))["params"])
    for fold, chosen in picks.items():
        weights = found.learned.models[fold, "elastic_net"].coefficients.toArray()
        assert all(v == 0 for n, v in zip(names, weights) if n not in chosen)
        assert found.learned.models[fold, "forest"].getNumTrees == found.best["forest"]["trees"]
    assert trust.auc(out.select(F.col("y_cls").alias("y"), F.col("prob_up").alias("p"))).first()["auc"] > 0.7
    # Inner folds hold rows of the first fold's training part alone.
    last = rows.where("fold = 0 AND role = 'train'").agg(F.max("date")).first()[0]
    assert tuning.inner_folds(rows, 2).agg(F.max("date")).first()[0] <= last
    with pytest.raises(guards.DataIntegrityError, match="no trial"):
        tuning.tuned(rows.withColumn("y_ret", F.lit(None).cast("double")), ["a"], ("elastic_net",), trials=1, inner=2)


def test_universe_and_market(spark, bars, tmp_path):
    path = tmp_path / "u.json"
    path.write_text(json.dumps({"symbols": ["S"], "config": {}}))
    assert files.read_universe(spark, str(path))["symbols"] == ["S"]
    path.write_text("{}")
    with pytest.raises(ValueError):
        files.read_universe(spark, str(path))
    own, other, missing = files.market(bars.unionByName(bars.limit(3)), ["S"], ["T", "U"])
    assert own.count() == 420 and other.count() == 380 and missing == ["U"]
    runs = verdicts.runs(spark.createDataFrame([("A.B",)], "symbol string"), spark.createDataFrame([("close",), ("open",)], "variant string"))
    assert {(r["key"], r["file"]) for r in runs.collect()} == {("A.B", "A_B"), ("A.B::open", "A_B__open")}


def test_clock_and_pending_stream(spark, tmp_path):
    at = lambda *a: dt.datetime(*a)
    times = [at(2021, 7, 6, 18, 55), at(2021, 7, 6, 19, 0), at(2021, 7, 6, 20, 30), at(2021, 7, 10, 15, 0), at(2021, 1, 6, 20, 0)]
    got = clock.with_clock(spark.createDataFrame([(t,) for t in times], "ts timestamp")).orderBy("ts").collect()
    shown = {r["ts"]: (r["minutes_to_close"], r["in_session"], r["late"], r["early"], str(r["last_closed"])) for r in got}
    assert shown[times[0]] == (65.0, True, False, False, "2021-07-05") and shown[times[2]] == (-30.0, False, True, False, "2021-07-06")
    assert shown[times[3]][1] is False and shown[times[3]][4] == "2021-07-10" and shown[times[4]][0] == 60.0
    bars = spark.createDataFrame([(dt.date(2021, 7, 5),), (dt.date(2021, 7, 6),)], "date date")
    assert clock.closed_bars(bars, times[1]).count() == 1 and clock.closed_bars(bars, times[2]).count() == 2
    signals = [("A", at(2021, 7, 6, 19), 0.6, 0.2, 100.0), ("B", at(2021, 7, 6, 19), 0.4, -0.2, 50.0)]
    closes = [("A", at(2021, 7, 6, 20), 101.0), ("A", at(2021, 7, 7, 20), 90.0), ("B", at(2021, 7, 20, 20), 40.0), ("A", at(2021, 7, 6, 18), 1.0)]
    spark.createDataFrame(signals, "symbol string, ts timestamp, prob double, position double, anchor double").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame(closes, "symbol string, close_ts timestamp, close double").write.parquet(str(tmp_path / "c"))
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / k)).schema).parquet(str(tmp_path / k)) for k in "sc"]
    query = clock.pending(*streams).writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = clock.first_close(spark.table("resolved")).collect()
    assert [(r["symbol"], r["close"], r["correct"]) for r in out] == [("A", 101.0, 1)] and out[0]["pnl"] == pytest.approx(0.2 * 0.01 - 0.2 * 8e-4)


def test_variant_choice_and_best_trials(spark):
    c = spark.createDataFrame([("X", "close", False, "REVISE"), ("X", "open", False, "GO"), ("Y", "close", None, "GO"), ("Y", "open", True, "NO-GO"), ("Z", "open", False, "GO")], "base string, variant string, winner boolean, verdict string")
    have = spark.createDataFrame([("X", "close"), ("X", "open"), ("Y", "close"), ("Y", "open")], "base string, variant string")
    assert {tuple(r) for r in verdicts.variant_choice(c, have).collect()} == {("X", "open"), ("Y", "open")}
    t = spark.createDataFrame([("f", 0, 0.5), ("f", 1, 0.5), ("f", 2, None), ("g", 0, float("nan")), ("g", 1, -1.0), ("h", 3, None)], "family string, trial int, score double")
    assert {(r["family"], r["trial"]) for r in verdicts.best_trials(t).collect()} == {("f", 0), ("g", 1), ("h", 3)}
    assert verdicts.trial_stats(t).first()["n"] == 3


def test_coherence_gate(spark):
    rows = [(0.2, 0.01), (0.2, -0.01), (-0.2, 0.01), (0.2, None), (0.0, -0.01), (-0.2, -0.01)]
    got = [r["p"] for r in spark.createDataFrame(rows, "pos double, mid double").select(backtest.coherent(F.col("pos"), F.col("mid")).alias("p")).collect()]
    assert got == [0.2, 0.0, 0.0, 0.2, 0.0, -0.2]


def test_snapshot(spark, bars):
    day, now = dt.date(2016, 3, 1), dt.datetime(2016, 3, 1, 20, 0)
    quote = lambda s, p, minutes: (s, "one", 1, now - dt.timedelta(minutes=minutes), p, 10.0)
    schema = "symbol string, source string, priority int, ts timestamp, price double, volume double"
    quotes_ = spark.createDataFrame([quote("S", 100.0, 300), quote("S", 101.0, 10), quote("T", 50.0, 200), quote("T", 51.0, 20)], schema)
    out = {r["symbol"]: r for r in anchoring.snapshot(bars, quotes_, day, now, ["tdy_gap", "tdy_anchor_ret"]).collect()}
    assert set(out) == {"S", "T"} and out["S"]["open"] == 100.0 and out["S"]["anchor"] == 101.0
    assert out["S"]["tdy_anchor_vs_open"] == pytest.approx(0.01)
    with pytest.raises(guards.StaleQuoteError):
        anchoring.snapshot(bars, quotes_.where("ts < '2016-03-01 19:00:00'"), day, now, [])
