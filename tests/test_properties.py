"""Literal fixtures, causality, invariants and injected faults."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import oscillators as osc
from tidemark.functions import recursive
from tidemark.functions import windows as w
from tidemark.operators import backtest, features, journal, labels, models, trust
from tidemark.sources import bars as src
from tidemark.streaming import quotes

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def walk(n, seed, symbol="S", start=dt.date(2015, 1, 1)):
    rng, price, rows = random.Random(seed), 100.0, []
    for k in range(n):
        o = price * (1 + rng.gauss(0, 0.004))
        c = o * (1 + rng.gauss(0, 0.01))
        rows.append((symbol, start + dt.timedelta(days=k), o, max(o, c) * (1 + abs(rng.gauss(0, 0.003))), min(o, c) * (1 - abs(rng.gauss(0, 0.003))), c, 1e6 * math.exp(rng.gauss(0, 0.3))))
        price = c
    return rows


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(420, 1) + walk(380, 2, "T"), SCHEMA)


def test_features_do_not_see_the_future(spark, bars):
    day = dt.date(2015, 11, 1)
    build = lambda b: features.weekly(features.today(osc.rsi(ind.streak(ind.overnight(ind.volatility(ind.momentum(b)))))))
    full, cut = (build(b).where(F.col("date") == day).orderBy("symbol").collect() for b in (bars, bars.where(F.col("date") <= day)))
    assert len(full) == 2
    for a, b in zip(full, cut):
        for name in a.asDict():
            assert a[name] == b[name] or a[name] == pytest.approx(b[name], rel=1e-9, abs=1e-12), name


def test_shift_base_moves_features_one_row(bars):
    rows = features.shift_base(ind.returns(bars), ["ret"]).orderBy("symbol", "date").collect()
    plain = ind.returns(bars).orderBy("symbol", "date").collect()
    assert rows[0]["ret"] is None and all(rows[k]["ret"] == plain[k - 1]["ret"] for k in range(1, 420))


def test_planted_leak_is_named(bars):
    rows = labels.build(bars).withColumn("leak", F.col("y_ret") * 0.9).withColumn("plain", F.col("volume")).withColumn("flat", F.lit(1.0))
    found = {r["feature"]: r["leak"] for r in features.leak_check(rows, ["leak", "plain", "flat"]).collect()}
    assert found == {"leak": True, "plain": False, "flat": False}


def test_smoothing_equals_the_recurrence(spark):
    x = [None, 1.0, None, None, 2.0, 5.0, None, 3.0]
    df = spark.createDataFrame([("S", dt.date(2020, 1, 1 + k), v) for k, v in enumerate(x)], "symbol string, date date, x double")
    got = [r["y"] for r in recursive.smooth(df, {"y": ("x", 0.3, 2)}).orderBy("date").collect()]
    want, y, decay, seen = [], None, 1.0, 0
    for v in x:
        if v is None:
            decay *= 0.7
        elif y is None:
            y, decay, seen = v, 1.0, 1
        else:
            a = decay * 0.7
            y, decay, seen = (a * y + 0.3 * v) / (a + 0.3), 1.0, seen + 1
        want.append(y if seen >= 2 else None)
    assert [g if g is None or not math.isnan(g) else None for g in got] == pytest.approx(want)


def test_rsi_without_losses_is_fifty(spark):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=k), *(float(100 + k),) * 4, 1.0) for k in range(40)]
    assert {r["rsi_14"] for r in osc.rsi(spark.createDataFrame(rows, SCHEMA)).collect()} == {50.0}


def test_constant_prices_give_null_not_errors(spark):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=k), 5.0, 5.0, 5.0, 5.0, 0.0) for k in range(80)]
    flat = spark.createDataFrame(rows, SCHEMA)
    out = ind.candles(ind.hurst(ind.stochastic(ind.bollinger(ind.momentum(flat))))).collect()
    assert all(r["stoch_k_14"] is None and r["candle_body"] is None and r["ret_skew_21"] is None for r in out)


@pytest.mark.parametrize("bad", [[("S", dt.date(2020, 1, 1), 1.0, 0.5, 2.0, 1.0, 1.0)], [("S", dt.date(2020, 1, 1), -1.0, 1.0, 1.0, 1.0, 1.0)], [("S", dt.date(2020, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)] * 2])
def test_corrupted_bars_are_counted(spark, bad):
    r = src.validation(spark.createDataFrame(bad, SCHEMA)).first()
    assert r["n_inverted"] + r["n_not_positive"] + r["n_repeated"] > 0


def test_anchor_takes_the_last_started_bar(spark):
    rows = [("S", dt.date(2026, 3, d), m, float(k), k + 1.0, k - 1.0, k + 0.5, 100) for d in (2, 3) for k, m in enumerate(range(570, 960, 30))]
    df = spark.createDataFrame(rows, "symbol string, day date, minute int, open double, high double, low double, close double, volume long")
    out = src.anchors(df, offset=30).collect()
    assert len(out) == 2 and all(r["anchor"] == 12.0 and r["partial_volume"] == 1300 for r in out)


def test_gap_invalidates_the_label_before_it(spark):
    rows = walk(60, 3)
    kept = rows[:30] + rows[45:]
    out = labels.build(spark.createDataFrame(kept, SCHEMA)).orderBy("date").collect()
    assert not out[29]["valid"] and out[28]["valid"] and out[30]["valid"]


@pytest.mark.parametrize("n", [0, 100, 700, 2500])
@pytest.mark.parametrize("anchored", [True, False])
def test_splits_keep_their_distance(n, anchored):
    for _, lo, hi, a, b in labels.walk_forward(n, anchored=anchored):
        assert 0 <= lo < hi and hi + 7 <= a < b <= n


def test_position_is_monotone_and_capped(spark):
    p = [0.4, 0.45, 0.48, 0.5, 0.52, 0.55, 0.6, 0.9]
    df = spark.createDataFrame([(x,) for x in p] + [(None,)], "p double")
    got = [r["s"] for r in df.select(backtest.position(F.col("p"), gain=3.0, cap=0.35).alias("s")).collect()]
    assert got[:-1] == sorted(got[:-1]) and got[3] == 0 and max(got) == 0.35 and got[-1] == 0


def test_cost_lowers_the_result_and_flat_earns_nothing(bars):
    rows = backtest.rule_signals(bars)
    total = lambda r, c: backtest.run(r, c).agg(F.sum("net")).first()[0]
    assert total(rows, 0.0) > total(rows, 5.0) > total(rows, 20.0)
    assert total(rows.withColumn("position", F.lit(0.0)), 20.0) == 0


def test_sharpe_and_drawdown_of_a_known_series(spark):
    net = [0.0004 + (0.005 if k % 2 else -0.005) for k in range(500)]
    rows = [("S", dt.date(2015, 1, 1) + dt.timedelta(days=k), 1.0, x) for k, x in enumerate(net)]
    df = spark.createDataFrame(rows, "symbol string, date date, position double, y_ret double")
    m = backtest.metrics(backtest.run(df, 0.0), ["symbol"]).first()
    mean = sum(net) / 500
    sd = math.sqrt(sum((x - mean) ** 2 for x in net) / 499)
    eq, peak, worst = 1.0, 0.0, 0.0
    for x in net:
        eq *= 1 + x
        peak = max(peak, eq)
        worst = min(worst, eq / peak - 1)
    assert m["sharpe"] == pytest.approx(mean / sd * math.sqrt(252)) and m["max_dd"] == pytest.approx(worst)


def test_overfitting_probability_of_noise_and_of_an_edge(spark):
    rng = random.Random(4)
    noise = [("A", t, c, rng.gauss(0, 0.01)) for t in range(1, 241) for c in range(12)]
    edge = [("B", t, c, rng.gauss(0.006 if c == 0 else 0, 0.01)) for t in range(1, 241) for c in range(12)]
    out = {r["symbol"]: r["pbo"] for r in trust.pbo(spark.createDataFrame(noise + edge, "symbol string, t long, config int, ret double")).collect()}
    assert out["B"] < 0.1 < out["A"]


def test_deflated_sharpe_falls_with_trials(spark):
    values = [trust.deflated_sharpe(0.1, 1000, k, 0.001)[0] for k in (2, 10, 100)]
    assert values == sorted(values, reverse=True) and 0 <= values[-1] <= values[0] <= 1
    assert trust.probabilistic_sharpe(0.0, 100) == pytest.approx(0.5) and trust.probabilistic_sharpe(0.5, 9) is None
    assert trust.deflated_sharpe(0.1, 1000, 1, 0.001) == (trust.probabilistic_sharpe(0.1, 1000), 0.0)
    assert trust.probabilistic_sharpe(0.1, 500, -1.0, 6.0) < trust.probabilistic_sharpe(0.1, 500)
    df = spark.createDataFrame([("a", 0.1, 1000, 10, 0.001, 0.0, 3.0), ("b", None, 1000, 10, None, 0.0, 3.0)], "symbol string, sr double, n long, trials long, variance double, skew double, kurt double")
    got = {r["symbol"]: r["deflated"] for r in trust.deflated(df).collect()}
    assert got["a"] == pytest.approx(values[1]) and got["b"] is None


def test_block_permutation_keeps_rows_and_values(bars):
    live = labels.build(bars).where("y_ret IS NOT NULL")
    rows = trust.block_permute(live, sims=3).where("symbol = 'S'").orderBy("sim", "__rn").collect()
    plain = [r["y_ret"] for r in live.where("symbol = 'S'").orderBy("date").collect()]
    for k in range(3):
        moved = [r["y_ret"] for r in rows if r["sim"] == k]
        assert len(moved) == 419 and sorted(moved) == sorted(plain) and moved != plain
        place = {v: i for i, v in enumerate(plain)}
        assert sum(place[b] - place[a] == 1 for a, b in zip(moved, moved[1:])) >= 419 - 22  # neighbours stay but at edges of blocks
    small = trust.block_permute(live.where("symbol = 'S'").limit(12), block=100)  # a block is a quarter of the rows at most
    assert small.count() == 12


def test_blend_is_symmetric_and_between(spark):
    r = spark.range(1).select(models.blend([F.lit(0.9), F.lit(0.1)], [1.0, 1.0]).alias("a"), models.blend([F.lit(0.6), F.lit(0.8)], [1.0, 1.0]).alias("b")).first()
    assert r["a"] == pytest.approx(0.5) and 0.6 < r["b"] < 0.8


def test_har_finds_planted_coefficients(spark):
    rng = random.Random(9)
    rows = [("S", *(d := (rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1))), 0.5 + 0.4 * d[0] + 0.3 * d[1] - 0.2 * d[2]) for _ in range(200)]
    df = spark.createDataFrame(rows, "symbol string, har_d double, har_w double, har_m double, log_rv_next double")
    r = models.har_ols(df).first()
    assert [r[c] for c in ("const", "day", "week", "month")] == pytest.approx([0.5, 0.4, 0.3, -0.2])
    lacking = df.limit(3).withColumn("har_d", F.lit(None).cast("double"))
    made = models.har_predict(df.unionByName(lacking), models.har_ols(df), df)
    assert made.where("har IS NULL").count() == 0 and made.count() == 203


def test_upsert_replaces_days_and_keeps_the_latest(spark):
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    old = spark.createDataFrame([(day(k), "old") for k in range(10)], "date date, v string")
    new = spark.createDataFrame([(day(9), "new"), (day(10), "new")], "date date, v string")
    assert [tuple(r) for r in journal.upsert(old, new, 3).orderBy("date").collect()] == [(day(8), "old"), (day(9), "new"), (day(10), "new")]


def test_unresolved_and_late_signals(spark):
    rows = walk(12, 5)
    bars = spark.createDataFrame(rows[:5] + rows[11:], SCHEMA)
    signals = bars.select("symbol", "date", F.lit(0.7).alias("prob"), F.lit(0.4).alias("position"), F.col("close").alias("anchor"))
    out = journal.resolve(signals, bars).orderBy("date").collect()
    assert [r["skipped"] for r in out] == [False, False, False, False, True, False]
    assert out[-1]["exit_date"] is None and out[0]["realized"] == pytest.approx(rows[1][5] / rows[0][5] - 1)


def test_as_of_keeps_matched_nulls(spark):
    day = lambda k: dt.date(2020, 1, k)
    rows = spark.createDataFrame([("S", day(k)) for k in range(1, 8)], "symbol string, date date")
    periods = spark.createDataFrame([("S", day(2), 1.0), ("S", day(5), None)], "symbol string, date date, v double")
    assert [r["v"] for r in features.as_of(rows, periods, ["v"]).orderBy("date").collect()] == [None, 1.0, 1.0, 1.0, None, None, None]


def test_stream_of_ticks_equals_the_batch(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    ticks.repartitionByRange(3, "ts").write.parquet(folder)
    stream = quotes.session_bars(quotes.ticks(spark, folder), late="60 days")
    query = stream.writeStream.format("memory").queryName("bars_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = quotes.session_bars(ticks).orderBy("symbol", "start").collect()
    assert spark.table("bars_now").orderBy("symbol", "start").collect() == want and len(want) > 10


def test_quote_status(spark):
    now = dt.datetime(2024, 1, 2, 15, 0)
    rows = [(100.0, now - dt.timedelta(minutes=m), 100.0) for m in (5, 60, 120)] + [(0.0, now, 100.0), (250.0, now, 100.0)]
    df = spark.createDataFrame(rows, "last double, quoted_at timestamp, prev double")
    assert [r["status"] for r in quotes.fresh(df, now, previous_close="prev").collect()] == ["ok", "degraded", "stale", "impossible", "impossible"]


def test_empty_tables(spark, bars):
    none = bars.limit(0)
    assert src.resample(none, "week").count() == 0 and labels.build(none).count() == 0
    assert backtest.metrics(backtest.run(backtest.rule_signals(none)), ["symbol"]).count() == 0
    assert w.EPS > 0 and trust.auc(spark.createDataFrame([], "y int, p double")).first()["auc"] is None
