"""Configuration, file sources and sinks, anchors on another scale."""

import datetime as dt
import json
import math

import pytest

from tidemark.config import Config, for_run
from tidemark.operators import anchoring, features
from tidemark.sources import files

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def bars(spark, n=40):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=k), 10.0 + k, 11.0 + k, 9.0 + k, 10.5 + k, 100.0) for k in range(n)]
    return spark.createDataFrame(rows, BAR)


def test_config():
    c = Config().checked()
    d = c.changed({"labels.horizon": "open_next", "costs.spread_bps": 3.0})
    assert d.labels.horizon == "open_next" and d.costs.one_way_bps == 6.0 and len(c.fingerprint()) == 12 and c.fingerprint() != d.fingerprint()
    for bad in ({"labels.horizon": "never"}, {"splits.purge": 0}, {"splits.purge": 1}, {"labels.horizon": "close_next2"}, {"costs.spread_bps": -1.0}, {"trust.blocks": 7}, {"trading.threshold": 1.0}, {"trading.least_position": 0.5}, {"models.trials": 2}):
        with pytest.raises(ValueError):
            c.changed(bad)
    with pytest.raises(KeyError):
        c.changed({"labels.nothing": 1})
    assert c.changed({"splits.purge": 3, "labels.horizon": "close_next2"}).splits.purge == 3
    universe = {"symbols": ["A", "B"], "config": {"splits.folds": 4, "_note": 1}, "variants": {"open": {"labels.horizon": "open_next", "splits.folds": 5}}, "overrides": {"B": {"splits.folds": 6}}}
    folds = lambda s, v=None: for_run(c, universe, s, v).splits.folds
    assert (folds("A"), folds("A", "open"), folds("B", "open")) == (4, 5, 6) and for_run(c, universe, "A", "open").labels.horizon == "open_next"


def test_bars_round_trip(spark, tmp_path):
    files.write_bars(bars(spark), str(tmp_path / "b"))
    assert sorted(files.read_bars(spark, str(tmp_path / "b")).collect()) == sorted(bars(spark).collect())
    named = bars(spark).toDF("Ticker", "Date", "Open", "High", "Low", "Adj Close", "Volume")
    named.write.option("header", True).csv(str(tmp_path / "c"))
    assert files.read_bars(spark, str(tmp_path / "c"), "csv").count() == 40
    bars(spark).drop("low").write.parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError, match="low"):
        files.read_bars(spark, str(tmp_path / "d"))


def test_parts_and_publication(spark, tmp_path):
    (tmp_path / "p" / "x").mkdir(parents=True)
    (tmp_path / "p" / "a.json").write_text(json.dumps({"k": "a", "v": 1.5}))
    (tmp_path / "p" / "x" / "b.json").write_text(json.dumps({"k": "b", "v": 2.5}))
    (tmp_path / "p" / "x" / "c.json").write_text("{broken")
    parts = files.read_parts(spark, str(tmp_path / "p"), "k string, v double")
    old = spark.createDataFrame([("a", 9.0), ("z", 7.0)], "k string, v double")
    assert sorted(map(tuple, files.merged(old, parts, ["k"]).collect())) == [("a", 1.5), ("b", 2.5), ("z", 7.0)]
    files.publish(spark.createDataFrame([("n", math.nan), ("i", math.inf), ("x", 1.0)], "k string, v double"), str(tmp_path / "out"))
    assert {(r["k"], r["v"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {("n", None), ("i", None), ("x", 1.0)}


def test_predictions_take_the_symbol_from_the_file(spark, tmp_path):
    (tmp_path / "SPY_oos.csv").write_text("date,p\n2020-01-01,0.5\n")
    (tmp_path / "QQQ_oos.csv").write_text("date,p\n2020-01-01,0.6\n")
    assert {(r["symbol"], r["p"]) for r in files.read_predictions(spark, f"{tmp_path}/*_oos.csv").collect()} == {("SPY", 0.5), ("QQQ", 0.6)}


def test_business_days(spark):
    got = [r["date"] for r in files.business_days(spark, "2024-01-05", "2024-01-09").collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 8), dt.date(2024, 1, 9)]


def test_anchor_scale(spark):
    b = bars(spark)
    other = b.where("date < '2020-02-05'").selectExpr("symbol", "date", "open / 0.984 AS anchor", "close / 0.984 AS session_close")
    rows = anchoring.rescaled(b, other).orderBy("date").collect()
    assert all(r["anchor"] == pytest.approx(r["open"] if r["is_real"] else r["close"]) for r in rows) and sum(r["is_real"] for r in rows) == 35
    few = anchoring.rescaled(b, other.limit(5)).collect()
    assert not any(r["is_real"] for r in few)
    assert anchoring.coverage(anchoring.rescaled(b, other)).first()["coverage"] == 35 / 40


def test_quotes_and_today(spark):
    t = dt.datetime(2020, 2, 10, 10, 0)
    rows = [("S", "5m", 2, t, 50.0, 5), ("S", "1m", 1, t, 51.0, 1), ("S", "1m", 1, t + dt.timedelta(hours=1), 52.0, 2), ("T", "daily", 3, t, 9.0, 1)]
    quotes = anchoring.first_available(spark.createDataFrame(rows, "symbol string, source string, priority int, ts timestamp, price double, volume long"), dt.date(2020, 2, 10))
    got = {r["symbol"]: (r["session_open"], r["price"], r["session_volume"], r["degraded"]) for r in quotes.collect()}
    assert got == {"S": (51.0, 52.0, 3, False), "T": (9.0, 9.0, 1, True)}
    b = bars(spark)
    assert anchoring.with_today(b, quotes, dt.date(2020, 2, 10)).count() == 42
    with pytest.raises(ValueError):
        anchoring.with_today(b, quotes, dt.date(2020, 1, 3))


def test_winsorised_covered_and_sequences(spark):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=k), float(k % 5) if k else 1e9, None if k % 2 else 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "symbol string, date date, a double, b double")
    assert features.winsorised(df, ["a", "b"], 2.0).agg({"a": "max"}).first()[0] < 1e9
    assert features.covered(df, ["a", "b"], 0.7).count() == 30
    steps = features.sequences(df.where("date > '2020-01-01'"), ["a"], 4).orderBy("date").collect()
    assert steps[0]["steps"] == [[1.0]] * 4 and steps[5]["steps"] == [[3.0], [4.0], [0.0], [1.0]]
