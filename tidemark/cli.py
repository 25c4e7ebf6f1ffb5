"""Command line: run, predict and scan over a table of bars.

    python -m tidemark.cli run     --bars BARS --out FOLDER --symbols A,B [--set labels.horizon=open_next]
    python -m tidemark.cli predict --bars BARS --models FOLDER --symbols A,B [--back 0]
    python -m tidemark.cli scan    --bars BARS --symbols A,B

`run` searches settings on inner folds, chooses features in each fold, trains on every fold, writes predictions, figures and the model; `predict` scores each symbol's last row with a stored
model; `scan` reports what is wrong with the bars. Paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import indicators as ind
from .operators import backtest, evidence, features, guards, labels, models, tuning, verdicts
from .sources import files

FEATURES = ["roc_1", "roc_5", "roc_21", "up_days_21", "rvol_21"]


def design(bars: DataFrame) -> DataFrame:
    """bars plus the features, each of the row before."""
    return features.shift_base(ind.momentum(ind.volatility(bars)), FEATURES)


def run(spark: SparkSession, bars: DataFrame, config: Config, out: str) -> DataFrame:
    """Search, select, train, backtest and judge; the figures by symbol, with their verdict."""
    guards.require_valid(bars, config.data.least_rows)
    rows = labels.weights(labels.build(design(bars), config.labels.horizon, max_gap=config.labels.max_gap).where("valid"), halflife=config.labels.halflife)
    guards.require_no_leak(rows, FEATURES)
    parts = labels.splits(rows, folds=config.splits.folds, purge=config.splits.purge, embargo=config.splits.embargo, least_train=config.splits.least_train, anchored=config.splits.anchored)
    guards.require_no_overlap(parts, config.splits.purge)
    placed = models._kept(labels.membership(rows, parts))
    m, s = config.models, config.splits
    scored, found = tuning.tuned(
        placed, FEATURES, m.families, m.trials, m.most_features, purge=s.purge, embargo=s.embargo, seed=m.seed, threshold=config.trading.threshold, cost_bps=config.costs.one_way_bps, refit=True
    )
    oos = models._kept(verdicts.keep_first(scored, ["symbol", "date"]))
    t = config.trading
    size = backtest.position(F.col("prob_up"), t.sizing, t.threshold, cap=t.most_position, least=t.least_position, leverage=t.leverage)
    trades = backtest.run(oos.withColumn("position", size), config.costs.one_way_bps)
    figures = evidence.figures(bars, placed, oos, trades, FEATURES, config.trust.permutations, config.costs.one_way_bps)
    judged = models._kept(verdicts.decide(figures, verdicts.trading_checks(config.trust.least_trades, config.trust.pbo_alarm, config.trust.dsr_alarm)))
    models.save(found.learned, spark, f"{out}/model")
    lines = [f"{r['symbol']}: {r['verdict']}, {r['n_failed']} of {r['n_critical']} critical checks failed" for r in judged.orderBy("symbol").collect()]
    files.write_result(out, "run", trades.select("symbol", "date", "fold", "prob_up", "position", "y_ret", "net"), judged, [f"settings {config.fingerprint()}", *[f"{f}: {json.dumps(p, sort_keys=True)}" for f, p in sorted(found.best.items())], *lines])
    return judged


def predict(spark: SparkSession, bars: DataFrame, folder: str, back: int = 0) -> DataFrame:
    return models.score_latest(models.load(spark, f"{folder}/model"), design(bars), back)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("run", "predict", "scan"))
    parser.add_argument("--bars", required=True)
    parser.add_argument("--kind", default="parquet")
    parser.add_argument("--symbols", default="")
    parser.add_argument("--out", default="")
    parser.add_argument("--models", default="")
    parser.add_argument("--back", type=int, default=0)
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    given = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    config = Config().changed({k: _value(v) for k, _, v in (s.partition("=") for s in given.set)})
    bars = files.read_bars(spark, given.bars, given.kind)
    wanted = [s for s in given.symbols.split(",") if s]
    bars = bars.where(F.col("symbol").isin(wanted)) if wanted else bars
    if given.command == "scan":
        out = guards.report(bars, config.data.least_rows)
    elif given.command == "predict":
        out = predict(spark, bars, given.models, given.back)
    else:
        out = run(spark, bars, config, given.out)
    out.show(truncate=False)
    return out


def _value(text: str):
    """A setting as JSON, or as it is where it is not JSON."""
    try:
        return json.loads(text)
    except ValueError:
        return text


if __name__ == "__main__":
    main()
