"""A whole run: a planted signal reaches GO, noise doesn't, and every figure of the verdict is worked out."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import Config
from tidemark.operators import evidence, trust, verdicts


def series(symbol, signal, n=1300, seed=3):
    rng, close, moves, out = random.Random(seed), 100.0, [0.0, 0.0], []
    for k in range(n):
        moves.append(signal * moves[-2] + rng.gauss(0, 0.01))
        opened, close = close, close * (1 + moves[-1])
        out.append((symbol, dt.date(2015, 1, 1) + dt.timedelta(days=k), opened, max(opened, close) * 1.001, min(opened, close) * 0.999, close, 1000.0 + k))
    return out


BARS = "symbol string, date date, open double, high double, low double, close double, volume double"


def test_a_planted_signal_reaches_go_and_noise_does_not(spark, tmp_path):
    bars = spark.createDataFrame(series("SIGNAL", 0.3, seed=3) + series("NOISE", 0.0, seed=4), BARS)
    path = str(tmp_path / "bars")
    bars.write.parquet(path)
    settings = ["--set", "splits.folds=3", "--set", "splits.least_train=400", "--set", 'models.families=["elastic_net"]', "--set", "trust.permutations=30"]
    judged = {r["symbol"]: r.asDict() for r in cli.main(["run", "--bars", path, "--out", str(tmp_path / "out"), *settings], spark).collect()}
    failed = {s: [c["check"] for c in r["checks"] if not c["passed"]] for s, r in judged.items()}
    for r in judged.values():
        assert all(r[c] is not None for c in ("pbo", "deflated", "skill", "continuous_n", "continuous_sharpe", "stress_p05", "p_sharpe", "auc", "share_positive", "hold_sharpe"))
    assert judged["SIGNAL"]["verdict"] == "GO", failed
    assert judged["NOISE"]["verdict"] == "NO-GO", failed


def test_candidates_pay_for_turnover_and_follow_signs(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    rng = random.Random(1)
    rows = [("S", d, rng.choice([-0.5, 0.0, 0.5]), rng.gauss(0, 0.01), rng.choice([None, -2.0, 0.0, 3.0])) for d in days]
    df = spark.createDataFrame(rows, "symbol string, date date, position double, y_ret double, f double")
    got = {(r["t"], r["config"]): r["ret"] for r in evidence.candidates(df, df, ["f"], 10.0).collect()}
    size = np.mean([abs(r[2]) for r in rows])
    for name, sides in (("model", [r[2] for r in rows]), ("rule_f", [np.sign(r[4] or 0) * size for r in rows])):
        before = [0.0, *sides[:-1]]
        for k, (now, was) in enumerate(zip(sides, before)):
            assert got[k + 1, name] == pytest.approx(now * rows[k][3] - abs(now - was) * 0.001)


def test_overfitting_figures_match_a_direct_computation(spark):
    rng = np.random.default_rng(5)
    perf = {c: rng.normal(m, 0.01, 200) for c, m in (("model", 0.002), ("rule_a", 0.0), ("rule_b", 0.0005))}
    df = spark.createDataFrame([("S", k + 1, c, float(v)) for c, x in perf.items() for k, v in enumerate(x)], "symbol string, t int, config string, ret double")
    r = evidence.overfitting(df).first()
    sr = {c: x.mean() / x.std(ddof=1) for c, x in perf.items()}
    x = perf["model"]
    z = (x - x.mean()) / x.std()
    want, _ = trust.deflated_sharpe(sr["model"], 200, 3, float(np.var(list(sr.values()), ddof=1)), float((z**3).mean()), float((z**4).mean()))
    assert r["deflated"] == pytest.approx(want) and 0 <= r["pbo"] <= 1
    flat = spark.createDataFrame([("S", k, "model", 0.0) for k in range(50)], df.schema)
    assert evidence.overfitting(flat).first()["deflated"] is None


def test_skill_and_defaults(spark):
    y = [k % 2 for k in range(100)]
    oos = spark.createDataFrame([("S", float(v), 0.2 + 0.6 * v) for v in y] + [("T", 1.0, 0.9)], "symbol string, y_cls double, prob_up double")
    got = {r["symbol"]: r["skill"] for r in evidence.skill(oos).collect()}
    assert got["S"] == pytest.approx(1 - 0.04 / 0.25) and got["T"] is None
    assert Config().trust.permutations > 20 and len(verdicts.trading_checks()) == 13
