"""Queries of guards, verdicts, feature blocks and model figures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..operators import backtest, blocks, calibration, features, guards, labels, models, quantiles, trust, tuning, verdicts
from ..sources import bars as src
from . import price_queries
from . import research_queries as research
from . import sql as q
from .price_queries import DAY, shown

QUERIES, SQL = {}, {}
col = F.col
YEAR = math.sqrt(252)


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return keep


RULES = {
    "errors": {"few_rows": "n < 100", "repeated_dates": "n > nd", "not_positive": "bad_px > 0", "high_below_low": "inverted > 0"},
    "warnings": {"outside_range": "outside > 0", "jumps": "jumps > 0", "nulls": "null_share > 0.05", "no_volume": "zero > 0.10", "gaps": "gaps > 0 AND n > 20"},
}


def _listed(rules):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


REPORT = f"""{q.staged({"ret": q.change("close"), "gap": f"date_diff('day', {q.lag('date')}, date)"})[0]}, a AS (SELECT symbol, count(*) AS n, count(DISTINCT date) AS nd,
  count_if(open <= 0 OR low <= 0 OR close <= 0) AS bad_px, count_if(high < low) AS inverted, count_if(open > high * 1.0001 OR open < low * 0.9999 OR close > high * 1.0001 OR close < low * 0.9999) AS outside,
  count_if(abs(ret) > 0.5) AS jumps, count_if(gap > 7) AS gaps, avg(CAST(volume <= 0 AS DOUBLE)) AS zero, max(abs(ret)) AS max_abs_return,
  greatest(avg(CAST(open IS NULL AS DOUBLE)), avg(CAST(close IS NULL AS DOUBLE)), avg(CAST(volume IS NULL AS DOUBLE))) AS null_share FROM s0 GROUP BY symbol)
SELECT symbol, n AS n_rows, {_listed(RULES["errors"])} AS errors, {_listed(RULES["warnings"])} AS warnings, round(max_abs_return, 6) + 0.0 AS max_abs_return, round(null_share, 6) + 0.0 AS max_null_share FROM a"""


@register("bar_report", REPORT)
def bar_report(spark, sf_dir):
    found = guards.report(src.daily(spark, sf_dir))
    joined = found.withColumns({c: F.array_join(c, ",") for c in ("errors", "warnings")})
    return shown(joined, ["symbol", "n_rows", "errors", "warnings"], ["max_abs_return", "max_null_share"])


SPLITS = research.SQL["splits_walkforward"]
register("split_overlaps", f"WITH sp AS ({SPLITS}) SELECT symbol, fold, train_hi, test_lo FROM sp WHERE train_hi > train_lo AND train_hi - 1 >= test_lo - 8 + 1")(
    lambda s, d: guards.overlaps(labels.splits(src.daily(s, d)), 8).select("symbol", "fold", "train_hi", "test_lo")
)
#: buy and hold beside the rule, and how often the side was right
HOLD = f"""{q.staged({"nxt": f"lead(close) OVER {q.SERIES}"}, {"raw": f"{q.ratio('nxt', 'close')} - 1"}, {"y_ret": "CASE WHEN abs(raw) <= 0.6 THEN raw END"})[0]},
t0 AS (SELECT *, 1.0 AS position FROM s2 WHERE y_ret IS NOT NULL), t1 AS (SELECT *, y_ret - abs(position - coalesce({q.lag('position')}, 0.0)) * 0.0004 AS net FROM t0),
h AS (SELECT symbol, count(*) AS n, avg(net) / stddev_samp(net) * {YEAR} AS sharpe, product(1 + net) - 1 AS total_return FROM t1 GROUP BY symbol)"""
register("buy_and_hold", q.select(["symbol", "n"], ["sharpe", "total_return"], (HOLD, "h"), 4))(
    lambda s, d: shown(backtest.metrics(backtest.buy_and_hold(backtest.rule_signals(src.daily(s, d))), ["symbol"]), ["symbol", "n"], ["sharpe", "total_return"], 4)
)
EDGE = f"""{research.RUN}, e AS (SELECT symbol, count(*) AS n, avg(CASE WHEN abs(position) > 1e-9 THEN CAST(sign(position) * sign(y_ret) > 0 AS DOUBLE) END) AS hit, avg(CAST(y_ret > 0 AS DOUBLE)) AS base_rate FROM trades GROUP BY symbol),
o AS (SELECT *, hit - base_rate AS edge FROM e)"""
register("base_rates", q.select(["symbol", "n"], ["hit", "base_rate", "edge"], (EDGE, "o")))(
    lambda s, d: shown(verdicts.base_rates(research.trades(s, d), ["symbol"]), ["symbol", "n"], ["hit", "base_rate", "edge"])
)
COVER = f"""{research.SIG}, sd AS (SELECT symbol, date, {q.rolled("stddev_pop", "r", 21, 10)} AS sd FROM (SELECT symbol, date, {q.change("close")} AS r FROM bars)),
j AS (SELECT f.symbol, realized AS y, -1.2816 * sd AS lo, 1.2816 * sd AS hi FROM fin f JOIN sd USING (symbol, date)),
c AS (SELECT symbol, count(CASE WHEN y IS NOT NULL AND lo IS NOT NULL THEN 1 END) AS n, avg(CASE WHEN y IS NOT NULL AND lo IS NOT NULL THEN CAST(y BETWEEN lo AND hi AS DOUBLE) END) AS coverage FROM j GROUP BY symbol)"""


@register("interval_coverage", q.select(["symbol", "n"], ["coverage"], (COVER, "c")))
def interval_coverage(spark, sf_dir):
    """How often the next close lies within the 10 to 90 % interval that the last 21 days' spread gives."""
    bars = src.daily(spark, sf_dir)
    spread = bars.withColumn("__r", w.change(col("close"))).select(*DAY, w.deviation(col("__r"), 21).alias("sd"))
    rows = research.resolved(spark, sf_dir).join(spread, DAY).withColumns({"lo": -1.2816 * col("sd"), "hi": 1.2816 * col("sd")})
    return shown(verdicts.interval_coverage(rows, "realized", "lo", "hi", ["symbol"]), ["symbol", "n"], ["coverage"])


PBY = f"{research.PORT}, y AS (SELECT CAST(year(date) AS INTEGER) AS year, count(*) AS n, product(1 + net) - 1 AS ret, avg(net) / stddev_samp(net) * {YEAR} AS sharpe FROM p GROUP BY 1 HAVING count(*) >= 30)"
register("portfolio_by_year", q.select(["year", "n"], ["ret", "sharpe"], (PBY, "y")))(
    lambda s, d: shown(backtest.portfolio_by_year(backtest.portfolio(research.trades(s, d))), ["year", "n"], ["ret", "sharpe"])
)
DIV = f"""{research.PAIRS}, e AS (SELECT symbol, avg(net) / stddev_samp(net) * {YEAR} AS sharpe FROM trades GROUP BY 1), m AS (SELECT count(sharpe) AS k, avg(sharpe) AS mean_sharpe FROM e),
o AS (SELECT k, mean_sharpe, rho AS mean_corr, mean_sharpe * sqrt(k) AS independent, mean_sharpe * sqrt(k / greatest(1 + (k - 1) * rho, 1e-9)) AS correlated FROM m, (SELECT avg(corr) AS rho FROM c))"""
DIVS = ["mean_corr", "mean_sharpe", "independent", "correlated"]
register("diversification", q.select(["k"], DIVS, (DIV, "o")))(lambda s, d: shown(backtest.diversification(research.trades(s, d)), ["k"], DIVS))
NOGO = research.SQL["verdict"]
PNG = f"""{research.RUN}, v AS ({NOGO}), live AS (SELECT * FROM trades WHERE symbol NOT IN (SELECT symbol FROM v WHERE verdict = 'NO-GO')), p AS (SELECT date, avg(net) AS net, count(*) AS k FROM live GROUP BY date)"""
register("portfolio_of_go", q.select(["date", "k"], ["net"], (PNG, "p")))(
    lambda s, d: shown(backtest.portfolio(research.trades(s, d), research.verdict(s, d)), ["date", "k"], ["net"])
)
FOLDS = f"""{research.RUN}, n AS (SELECT symbol, count(*) AS n FROM trades GROUP BY 1), b AS (SELECT t.*, row_number() OVER (PARTITION BY t.symbol ORDER BY date) - 1 AS rn, n.n AS m, (n.n - 500) // 8 AS size FROM trades t JOIN n USING (symbol)),
f AS (SELECT *, CAST(least(7, (rn - 500) // size) AS INTEGER) AS fold FROM b WHERE size > 0 AND rn >= 500),
o AS (SELECT symbol, fold, count(*) AS n, avg(net) / stddev_samp(net) * {YEAR} AS sharpe, product(1 + net) - 1 AS total_return, avg(CASE WHEN abs(position) > 1e-9 THEN CAST(net > 0 AS DOUBLE) END) AS hit, min(date) AS first, max(date) AS last FROM f GROUP BY 1, 2)"""
FOLDED = ["sharpe", "total_return", "hit"]


@register("fold_figures", q.select(["symbol", "fold", "n", "first", "last"], FOLDED, (FOLDS, "o")))
def fold_figures(spark, sf_dir):
    """Figures of the rule's trades by symbol and test fold."""
    rows = research.trades(spark, sf_dir)
    tested = labels.membership(rows, labels.splits(rows)).where("role = 'test'")
    return shown(verdicts.fold_figures(tested, ["symbol", "fold"]), ["symbol", "fold", "n", "first", "last"], FOLDED)


#: Figures by symbol; the two of the deflated and the permuted Sharpe are stood in for by the t-statistic, which SQL has.
FULL = f"""{research.METRICS}, hold AS (SELECT symbol, avg(hn) / stddev_samp(hn) * {YEAR} AS hold_sharpe, avg(CAST(y_ret > 0 AS DOUBLE)) AS base_rate
  FROM (SELECT symbol, y_ret, y_ret - abs(1.0 - (CASE WHEN row_number() OVER {q.SERIES} = 1 THEN 0.0 ELSE 1.0 END)) * 0.0004 AS hn FROM trades) GROUP BY symbol),
yr AS (SELECT symbol, year(date) AS year, avg(net) / stddev_samp(net) AS sr FROM trades GROUP BY 1, 2 HAVING count(*) >= 20), st AS (SELECT symbol, avg(CAST(sr > 0 AS DOUBLE)) AS share_positive FROM yr GROUP BY 1),
j AS (SELECT o.*, hold_sharpe, base_rate, share_positive, 0.5 + 0.02 * sign(sharpe) AS auc, CASE WHEN t_stat > 1.6449 THEN 0.01 ELSE 0.5 END AS p_sharpe, CASE WHEN t_stat > 1.2816 THEN 0.95 ELSE 0.5 END AS deflated FROM o JOIN hold USING (symbol) JOIN st USING (symbol)),
k AS (SELECT symbol, list_filter([CASE WHEN NOT coalesce(n_active >= 60, FALSE) THEN 'enough trades' END, CASE WHEN NOT coalesce(coalesce(sharpe_overlap_adj, sharpe) > 0.3, FALSE) THEN 'positive Sharpe' END,
  CASE WHEN NOT coalesce(auc > 0.52, FALSE) THEN 'AUC' END, CASE WHEN directional_accuracy - base_rate <= 0.005 THEN 'beats the base rate' END, CASE WHEN coalesce(sharpe_overlap_adj, sharpe) <= hold_sharpe THEN 'beats buying and holding' END,
  CASE WHEN NOT coalesce(deflated >= 0.9, FALSE) THEN 'deflated Sharpe' END, CASE WHEN NOT coalesce(p_sharpe < 0.05, FALSE) THEN 'not by chance' END, CASE WHEN NOT coalesce(share_positive >= 0.6, FALSE) THEN 'steady over folds' END], lambda x: x IS NOT NULL) AS failed FROM j)
SELECT symbol, array_to_string(failed, ', ') AS failed, CAST(len(failed) AS INTEGER) AS n_failed, CASE WHEN len(failed) = 0 THEN 'GO' WHEN len(failed) <= 2 THEN 'REVISE' ELSE 'NO-GO' END AS verdict FROM k"""


@register("full_verdict", FULL)
def full_verdict(spark, sf_dir):
    made = research.trades(spark, sf_dir)
    figures = backtest.metrics(made, ["symbol"])
    hold = backtest.metrics(backtest.buy_and_hold(made.select("symbol", "date", "y_ret")), ["symbol"]).select("symbol", col("sharpe").alias("hold_sharpe"))
    steady = backtest.by_year(made).groupBy("symbol").agg(F.avg((col("sharpe") > 0).cast("double")).alias("share_positive"))
    rows = figures.join(hold, "symbol").join(steady, "symbol").join(verdicts.base_rates(made, ["symbol"]).select("symbol", "base_rate"), "symbol")
    none = F.lit(None).cast("double")
    rows = rows.withColumns(
        {
            "auc": 0.5 + 0.02 * F.signum("sharpe"), "p_sharpe": F.when(col("t_stat") > 1.6449, 0.01).otherwise(0.5), "deflated": F.when(col("t_stat") > 1.2816, 0.95).otherwise(0.5),
            "pbo": none, "skill": none, "continuous_n": none, "continuous_sharpe": none, "stress_p05": none,
        }
    )
    judged = verdicts.decide(rows, verdicts.trading_checks())
    failed = F.transform(F.filter("checks", lambda c: c["critical"] & ~c["passed"]), lambda c: c["check"])
    return judged.select("symbol", F.array_join(failed, ", ").alias("failed"), "n_failed", "verdict")


#: HAR fitted by symbol and fold, judged on the fold's test rows.
def _gram(keys: str, source: str) -> str:
    terms = {"1": "1.0", "d": "har_d", "w": "har_w", "m": "har_m"}
    sums = ", ".join(f"sum({a} * {b}) AS g_{i}{j}" for i, a in terms.items() for j, b in terms.items()) + ", " + ", ".join(f"sum({a} * log_rv_next) AS b_{i}" for i, a in terms.items())
    steps, last, n = [f"n0 AS (SELECT {keys}, {sums} FROM {source} GROUP BY {keys})"], "n0", "1dwm"
    for k, p in enumerate(n):
        row = [f"g_{p}{j} / g_{p}{p} AS g_{p}{j}" for j in n] + [f"b_{p} / g_{p}{p} AS b_{p}"]
        rest = [f"g_{i}{j} - g_{i}{p} * g_{p}{j} / g_{p}{p} AS g_{i}{j}" for i in n if i != p for j in n] + [f"b_{i} - g_{i}{p} * b_{p} / g_{p}{p} AS b_{i}" for i in n if i != p]
        steps.append(f"n{k + 1} AS (SELECT {keys}, {', '.join(row + rest)} FROM {last})")
        last = f"n{k + 1}"
    return ", ".join(steps)


HFOLD = f"""{research.HAR}, live AS (SELECT *, row_number() OVER {q.SERIES} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM s3 WHERE har_d IS NOT NULL AND har_w IS NOT NULL AND har_m IS NOT NULL AND log_rv_next IS NOT NULL),
k AS (SELECT l.*, CAST(f AS INTEGER) AS fold, (n - 500) // 8 AS size FROM live l, range(8) r(f)), tr AS (SELECT * FROM k WHERE size > 0 AND rn < 500 + fold * size - 7), te AS (SELECT * FROM k WHERE size > 0 AND rn >= 500 + fold * size AND rn < CASE WHEN fold = 7 THEN n ELSE 500 + (fold + 1) * size END),
{_gram("symbol, fold", "tr")}, mu AS (SELECT symbol, fold, avg(log_rv_next) AS mu FROM tr GROUP BY 1, 2),
pr AS (SELECT te.symbol, te.fold, log_rv_next AS y, mu, b_1 + b_d * har_d + b_w * har_w + b_m * har_m AS p FROM te JOIN n4 USING (symbol, fold) JOIN mu USING (symbol, fold)),
o AS (SELECT symbol, fold, count(*) AS n, 1 - sum(pow(y - p, 2)) / sum(pow(y - mu, 2)) AS r2_mean, avg(exp(2 * (y - p)) - 2 * (y - p) - 1) AS qlike FROM pr GROUP BY 1, 2)"""


def har_folds(spark, sf_dir):
    rows = trust.har(src.daily(spark, sf_dir)).where("har_d IS NOT NULL AND har_w IS NOT NULL AND har_m IS NOT NULL AND log_rv_next IS NOT NULL")
    return labels.membership(rows, labels.splits(rows))


@register("har_walk_forward", q.select(["symbol", "fold", "n"], ["r2_mean", "qlike"], (HFOLD, "o"), 4))
def har_walk_forward(spark, sf_dir):
    """Out-of-sample R2 against the training mean, and QLIKE, of HAR by symbol and fold."""
    rows, keys = har_folds(spark, sf_dir), ["symbol", "fold"]
    train, test = rows.where("role = 'train'"), rows.where("role = 'test'")
    mean = train.groupBy(*keys).agg(F.avg("log_rv_next").alias("mu"))
    made = models.har_predict(test, models.har_ols(train, keys=keys), train, keys).join(mean, keys)
    scores = trust.forecast_scores(made, "log_rv_next", "har", "mu", keys).withColumnRenamed("r2_oos", "r2_mean")
    return shown(scores, [*keys, "n"], ["r2_mean", "qlike"], 4)


@register("volatility_experiment")
def volatility_experiment(spark, sf_dir):
    """Verdict by symbol on a residual model over HAR, on all test rows of all folds."""
    bars = src.daily(spark, sf_dir)
    base = features.shift_base(ind.volatility(bars).select(*DAY, "rvol_5", "rvol_21", "pvol_21"), ["rvol_5", "rvol_21", "pvol_21"])
    rows = har_folds(spark, sf_dir).join(base, DAY)
    made = models.volatility_experiment(rows, ["rvol_5", "rvol_21", "pvol_21"])
    by_fold = trust.forecast_scores(made, "y", "ml", "har", ["symbol", "fold"]).groupBy("symbol").agg(F.avg((col("r2_oos") > 0).cast("double")).alias("share_better"))
    gain = trust.forecast_scores(made, "y", "ml", "har", ["symbol"]).select("symbol", "n", col("r2_oos").alias("r2_har"), "qlike", col("qlike_benchmark").alias("qlike_har"), "mz_beta")
    mean = trust.forecast_scores(made, "y", "ml", "mu", ["symbol"]).select("symbol", col("r2_oos").alias("r2_mean"))
    loss = made.select("symbol", "date", (F.pow(col("y") - col("ml"), 2) - F.pow(col("y") - col("har"), 2)).alias("d"))
    dm = trust.with_normal_p(trust.diebold_mariano(loss).select("symbol", "dm"), "dm", "dm_p")
    figures = gain.join(mean, "symbol").join(by_fold, "symbol").join(dm, "symbol")
    return verdicts.decide(figures, verdicts.volatility_checks(), 1).drop("checks")


STEPS = 12
QROWS = q.staged(
    {"ret": q.change("close"), "nxt": f"lead(close) OVER {q.SERIES}", "rn": f"row_number() OVER {q.SERIES} - 1", "rows": "count(*) OVER (PARTITION BY symbol)"},
    {"y": f"{q.ratio('nxt', 'close')} - 1", "sd": q.deviation("ret", 21, 10, 1)}, {"raw": "CASE WHEN sd IS NOT NULL THEN greatest(sd, 1e-4) END"},
    {"x": "last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)", "p": "CASE WHEN ret > 0 THEN 0.6 ELSE 0.4 END"},
)
QFOLDS = f"""{QROWS[0]}, qk AS (SELECT *, CAST(f AS INTEGER) AS fold, (rows - 500) // 8 AS size FROM {QROWS[1]}, range(8) r(f) WHERE y IS NOT NULL AND x IS NOT NULL AND rows >= 508),
tr AS (SELECT * FROM qk WHERE rn < 500 + fold * size - 7), te AS (SELECT * FROM qk WHERE rn >= 500 + fold * size AND rn < CASE WHEN fold = 7 THEN rows ELSE 500 + (fold + 1) * size END),
b0 AS (SELECT symbol, fold, l, 0.01 * avg(abs(y)) AS e, 0.0 AS c, 0.0 AS d FROM tr, (VALUES (0.1), (0.5), (0.9)) v(l) GROUP BY ALL), """ + ", ".join(
    f"""b{k} AS MATERIALIZED (SELECT symbol, fold, l, e, (g * hxx - gx * hx) / (h * hxx - hx * hx) AS c, (h * gx - hx * g) / (h * hxx - hx * hx) AS d FROM (
SELECT symbol, fold, l, e, sum(v) AS h, sum(v * x) AS hx, sum(v * x * x) AS hxx, sum(v * y + 2 * l - 1) AS g, sum((v * y + 2 * l - 1) * x) AS gx
FROM (SELECT *, 1 / (e + abs(y - c - d * x)) AS v FROM tr JOIN b{k - 1} USING (symbol, fold)) GROUP BY ALL))"""
    for k in range(1, STEPS + 1)
) + f""", qs AS (SELECT te.symbol, te.date, te.fold, any_value(y) AS y, any_value(x) AS x, any_value(p) AS p, list_sort(list(c + d * x)) AS qs FROM te JOIN b{STEPS} USING (symbol, fold) GROUP BY 1, 2, 3),
o AS (SELECT symbol, fold, count(*) AS n, avg(CAST(y BETWEEN qs[1] AND qs[3] AS DOUBLE)) AS coverage, avg(qs[3] - qs[1]) AS width,
  avg(greatest(0.5 * (y - qs[2]), -0.5 * (y - qs[2]))) AS loss_q50, avg(CAST(sign(p - 0.5) <> sign(qs[2]) AS DOUBLE)) AS gated,
  avg(abs(greatest(-1.0, least(1.0, qs[2] / greatest(x * x, 1e-8) * 0.25)))) AS kelly FROM qs GROUP BY 1, 2)"""
QSHOWN = ["coverage", "width", "loss_q50", "gated", "kelly"]


@register("quantile_forecasts", q.select(["symbol", "fold", "n"], QSHOWN, (QFOLDS, "o"), 5))
def quantile_forecasts(spark, sf_dir):
    """Forecast quantiles of the next return by symbol and fold: coverage of P10 to P90, loss of the median, the share of positions that the
    median takes away, and what Kelly sizing makes of it. Test rows only; fitted on each fold's training rows."""
    keys = ["symbol", "fold"]
    daily = labels.build(src.daily(spark, sf_dir))
    rows = labels.membership(daily.withColumn("p", F.when(w.change(col("close")) > 0, 0.6).otherwise(0.4)), labels.splits(daily))
    rows = models._kept(rows.where("y_ret IS NOT NULL AND sigma IS NOT NULL").select("symbol", "date", "fold", "role", "y_ret", "sigma", "p"))
    fitted = quantiles.fit(rows.where("role = 'train'"), ["sigma"], keys, rounds=STEPS, tolerance=0.0)
    made = quantiles.forecasts(rows.where("role = 'test'"), fitted, ["sigma"], keys)
    before = backtest.position(col("p"))
    made = made.withColumns({"gated": ((before != 0) & (backtest.coherent(before, col("q50")) == 0)).cast("double"), "kelly": F.abs(backtest.position(col("p"), "kelly", expected=col("q50"), sigma=col("sigma")))})
    more = made.groupBy(*keys).agg(F.avg("gated").alias("gated"), F.avg("kelly").alias("kelly"))
    return shown(quantiles.quality(made, keys).join(more, keys), [*keys, "n"], QSHOWN, 5)


@register("model_search")
def model_search(spark, sf_dir):
    """Random settings of four families over two inner folds, with the best of each family marked."""
    rows = research.fold_rows(spark, sf_dir, folds=2)
    trials = models._kept(models.search(rows, research.MOM, (*models.FAMILIES, "perceptron"), 2))
    best = verdicts.best_trials(trials).select("family", "trial", F.lit(True).alias("best"))
    return trials.join(best, ["family", "trial"], "left").withColumn("best", F.coalesce("best", F.lit(False)))


@register("tuned_walk_forward")
def tuned_walk_forward(spark, sf_dir):
    """Out-of-sample probabilities of every fold after search and selection: settings from inner folds of the first fold's
    training rows, the three best features of each fold by a probe model, every test row scored."""
    return tuning.tuned(research.fold_rows(spark, sf_dir, folds=4), research.MOM, trials=6, most=len(research.MOM) - 1)[0]


@register("label_permutation")
def label_permutation(spark, sf_dir):
    """p-values of Sharpe and AUC against refits on permuted labels."""
    return models.permutation_test(research.fold_rows(spark, sf_dir), research.MOM)


@register("feature_importance")
def feature_importance(spark, sf_dir):
    """By how much the AUC of a probe model falls without each feature, on the last fold's test rows."""
    rows = research.fold_rows(spark, sf_dir, folds=2)
    last = rows.where("fold = 1")
    fitted = models.preparation(last.where("role = 'train'"), research.MOM)
    ready = models._kept(models.prepared(last, fitted, research.MOM).select("role", "x", "y_cls", "weight"))
    probe = models.estimator("boosted", {"rounds": 5}, len(research.MOM)).fit(ready.where("role = 'train'"))
    return models.permutation_importance(probe, ready.where("role = 'test'"), research.MOM)


@register("next_day_scores")
def next_day_scores(spark, sf_dir):
    """Each symbol's last row scored by the last fold's models, refitted on all they may see, with its health."""
    rows = research.fold_rows(spark, sf_dir, folds=2)
    _, learned = models.walk_forward(rows, research.MOM, ("elastic_net", "forest"), refit=True)
    latest = features.shift_base(ind.momentum(src.daily(spark, sf_dir)), research.MOM)
    return models.score_latest(learned, latest).withColumn("warnings", F.array_join("warnings", ","))


HEALTH = f"""{research.FIRST}, q AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM (SELECT * FROM pl WHERE rn <= floor(0.8 * n)) UNPIVOT (value FOR feature IN (roc_1, roc_5, roc_21, up_days_21)) GROUP BY 1),
u AS (SELECT symbol, date, feature, value FROM (SELECT * FROM pl WHERE rn > floor(0.8 * n)) UNPIVOT INCLUDE NULLS (value FOR feature IN (roc_1, roc_5, roc_21, up_days_21))),
h AS (SELECT symbol, date, avg(CAST(value IS NULL AS DOUBLE)) AS null_share, avg(coalesce(CAST(NOT (value BETWEEN lo AND hi) AS DOUBLE), 0.0)) AS outside_share, CAST(date_diff('day', DATE '1998-01-01', date) AS INTEGER) AS age_days FROM u JOIN q USING (feature) GROUP BY symbol, date)
SELECT symbol, date, age_days, round(null_share, 6) + 0.0 AS null_share, round(outside_share, 6) + 0.0 AS outside_share,
  array_to_string(list_filter([CASE WHEN null_share > 0.3 THEN 'empty' END, CASE WHEN outside_share > 0.25 THEN 'outside' END, CASE WHEN age_days > 120 THEN 'old' END], lambda x: x IS NOT NULL), ',') AS warnings FROM h"""


@register("snapshot_health", HEALTH)
def snapshot_health(spark, sf_dir):
    """Later rows of each symbol against the footprint of its first four fifths."""
    rows = ind.momentum(src.daily(spark, sf_dir)).withColumns({"__rn": F.row_number().over(w.series()), "__n": F.count("*").over(w.Window.partitionBy("symbol"))})
    early = F.floor(0.8 * col("__n"))
    print_ = trust.footprint(rows.where(col("__rn") <= early), research.MOM)
    made = guards.health(rows.where(col("__rn") > early), print_, research.MOM, "1998-01-01")
    return shown(made.withColumn("warnings", F.array_join("warnings", ",")), [*DAY, "age_days", "warnings"], ["null_share", "outside_share"])


TRIALS = f"""{research.YEARS}, t AS (SELECT symbol AS family, year AS trial, CASE WHEN year % 5 = 0 THEN NULL ELSE sharpe END AS score FROM y)"""


def yearly_trials(spark, sf_dir):
    """The rule's years as trials of their symbol, every fifth without a score."""
    made = backtest.by_year(research.trades(spark, sf_dir))
    return made.select(col("symbol").alias("family"), col("year").alias("trial"), F.when(col("year") % 5 != 0, col("sharpe")).alias("score"))


register("best_trials", f"{TRIALS} SELECT family, trial, round(score, 6) + 0.0 AS score FROM t QUALIFY row_number() OVER (PARTITION BY family ORDER BY coalesce(score, CAST('-Infinity' AS DOUBLE)) DESC, trial) = 1")(
    lambda s, d: shown(verdicts.best_trials(yearly_trials(s, d)), ["family", "trial"], ["score"])
)
TS = ["median", "best", "variance"]
register("trial_stats", q.select(["n"], TS, (f"{TRIALS}, o AS (SELECT count(*) AS n, median(score) AS median, max(score) AS best, var_samp(score) AS variance FROM t WHERE score IS NOT NULL)", "o")))(
    lambda s, d: shown(verdicts.trial_stats(yearly_trials(s, d)), ["n"], TS)
)
register("selection_rate", f"{TRIALS}, p AS (SELECT trial AS fold, family AS feature FROM t WHERE score > 0), k AS (SELECT count(DISTINCT fold) AS k FROM p) SELECT feature, round(count(DISTINCT fold) / max(k.k), 6) + 0.0 AS rate FROM p, k GROUP BY 1")(
    lambda s, d: shown(verdicts.selection_rate(yearly_trials(s, d).where("score > 0").select(col("trial").alias("fold"), col("family").alias("feature"))), ["feature"], ["rate"])
)
RESULTS = f"""{TRIALS}, r AS (SELECT family AS symbol, CAST(trial % 3 AS INTEGER) AS horizon, score AS r2_har, CASE WHEN trial % 2 = 0 THEN 0.01 ELSE 0.2 END AS dm_p, CASE WHEN score > 0.5 THEN 'GO' ELSE 'NO-GO' END AS verdict FROM t)"""


def results(spark, sf_dir):
    return yearly_trials(spark, sf_dir).select(
        col("family").alias("symbol"), (col("trial") % 3).alias("horizon"), col("score").alias("r2_har"), F.when(col("trial") % 2 == 0, 0.01).otherwise(0.2).alias("dm_p"), F.when(col("score") > 0.5, "GO").otherwise("NO-GO").alias("verdict")
    )


register("roll_up", f"""{RESULTS} SELECT horizon, count(*) AS n, round(avg(r2_har), 6) + 0.0 AS mean_gain, count_if(r2_har > 0)::BIGINT AS n_above, count_if(r2_har > 0 AND dm_p < 0.05)::BIGINT AS n_significant, count_if(verdict = 'GO')::BIGINT AS n_go,
coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE verdict = 'GO'), '') AS go FROM r GROUP BY horizon""")(
    lambda s, d: shown(verdicts.roll_up(results(s, d)).withColumn("go", F.array_join("go", ",")), ["horizon", "n", "n_above", "n_significant", "n_go", "go"], ["mean_gain"])
)
BOARD = f"{RESULTS}, b AS (SELECT symbol, avg(r2_har) AS r2_har FROM r GROUP BY 1)"
register("leaderboard", f"{BOARD} SELECT symbol, round(r2_har, 6) + 0.0 AS r2_har, CAST(row_number() OVER (ORDER BY r2_har DESC NULLS LAST, symbol) AS INTEGER) AS place FROM b")(
    lambda s, d: shown(verdicts.leaderboard(results(s, d).groupBy("symbol").agg(F.avg("r2_har").alias("r2_har"))), ["symbol", "place"], ["r2_har"])
)
register("recent_120", f"WITH {q.BARS} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 120")(
    lambda s, d: verdicts.recent(src.daily(s, d)).select(*DAY, "close")
)
CHOICE = f"""{research.WIN}, c AS (SELECT base, variant, verdict_rank, edge, variant IN ('1993', '1996') AS winner, CASE verdict_rank WHEN 2 THEN 'GO' WHEN 1 THEN 'REVISE' ELSE 'NO-GO' END AS verdict FROM r),
m AS (SELECT * FROM c WHERE CAST(variant AS INTEGER) % 2 = 0)
SELECT base, variant FROM m QUALIFY row_number() OVER (PARTITION BY base ORDER BY winner DESC, CASE verdict WHEN 'GO' THEN 2 WHEN 'REVISE' THEN 1 ELSE 0 END DESC, variant <> '1994', variant) = 1"""


@register("variant_choice", CHOICE)
def variant_choice(spark, sf_dir):
    years = backtest.by_year(research.trades(spark, sf_dir))
    made = years.select(
        col("symbol").alias("base"), col("year").cast("string").alias("variant"), col("year").isin(1993, 1996).alias("winner"),
        F.when(col("sharpe") > 0.5, "GO").when(col("sharpe") > 0, "REVISE").otherwise("NO-GO").alias("verdict"),
    )
    return verdicts.variant_choice(made, made.where(col("variant").cast("int") % 2 == 0), "1994")


register("model_runs", """SELECT p_brand AS symbol, v AS variant, CASE WHEN v = 'close' THEN p_brand ELSE p_brand || '::' || v END AS key,
replace(p_brand, '.', '_') || CASE WHEN v = 'close' THEN '' ELSE '__' || v END AS file FROM (SELECT DISTINCT p_brand FROM part), (VALUES ('close'), ('open'), ('two')) t(v)""")(
    lambda s, d: verdicts.runs(src.table(s, d, "part").select(col("p_brand").alias("symbol")).distinct(), s.range(1).select(F.explode(F.array(*map(F.lit, ("close", "open", "two")))).alias("variant")))
)
EARLY = f"""WITH {q.BARS}, k AS (SELECT symbol, date, close, CAST(f AS INTEGER) AS fold FROM bars, range(3) r(f) WHERE (day(date) + f) % 3 <> 0)
SELECT symbol, date, fold FROM k QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY fold) = 1"""
register("keep_first", EARLY)(
    lambda s, d: verdicts.keep_first(
        src.daily(s, d).withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(3)]))).where((F.day("date") + col("fold")) % 3 != 0), DAY
    ).select(*DAY, "fold")
)


@register("stacking_weights")
def stacking_weights(spark, sf_dir):
    """Weights of three scores by language, from logistic regressions fitted side by side."""
    rows = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    made = rows.select("lang", col("quality").alias("y_cls"), ((col("doc_id") % 101) / F.lit(101.0)).alias("a"), (1 / (1 + F.exp(-(F.log1p("n_chars") - 6)))).alias("b"), F.lit(0.9).alias("c"))
    weights = calibration.stacking_weights(made, ["a", "b", "c"], ["lang"])
    return spark.createDataFrame([(k[0], *v) for k, v in sorted(weights.items())], "lang string, a double, b double, c double")


CLOCK = f"""WITH t AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS lt FROM events), c AS (SELECT *, date_diff('second', lt, CAST(CAST(lt AS DATE) AS TIMESTAMP) + INTERVAL 16 HOUR) / 60.0 AS left_ FROM t)
SELECT event_id, CAST(lt AS DATE) AS day, round(left_, 4) + 0.0 AS minutes_to_close, isodow(lt) < 6 AND lt >= CAST(CAST(lt AS DATE) AS TIMESTAMP) + INTERVAL '9:30' HOUR TO MINUTE AND left_ >= 0 AS in_session,
  left_ - 60 < -10 AS late, left_ - 60 > 10 AS early, CASE WHEN left_ <= 0 OR isodow(lt) >= 6 THEN CAST(lt AS DATE) ELSE CAST(lt AS DATE) - 1 END AS last_closed FROM c"""


@register("market_clock", CLOCK.replace("INTERVAL '9:30' HOUR TO MINUTE", "INTERVAL 570 MINUTE").replace("CAST(lt AS DATE) - 1", "CAST(CAST(lt AS DATE) - 1 AS DATE)"))
def market_clock(spark, sf_dir):
    from ..streaming import clock

    made = clock.with_clock(src.table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    return shown(made, ["event_id", "day", "in_session", "late", "early", "last_closed"], ["minutes_to_close"], 4)


LAGS = [f"ret_lag_{k}" for k in range(1, 6)]
BASED = [*LAGS, "sma_cross_20_50", "sma_cross_50_200", "vol_ratio_5_63", "vol_z_252", "overnight_vs_intraday_21", "roc_126_z", "dist_sma_200"]
BASE = q.staged(
    {"ret_lag_1": q.change("close"), "s20": q.mean("close", 20), "s50": q.mean("close", 50), "s200": q.mean("close", 200), "gap": f"{q.ratio('open', q.lag('close'))} - 1", "idr": f"{q.ratio('close', 'open')} - 1", "roc_126": q.change("close", 126)},
    {**{f"ret_lag_{k}": q.lag("ret_lag_1", k - 1) for k in range(2, 6)}, "r5": f"{q.deviation('ret_lag_1', 5)} * {YEAR}", "r21": f"{q.deviation('ret_lag_1', 21)} * {YEAR}", "r63": f"{q.deviation('ret_lag_1', 63)} * {YEAR}"},
    {"sma_cross_20_50": f"{q.ratio('s20', 's50')} - 1", "sma_cross_50_200": f"{q.ratio('s50', 's200')} - 1", "vol_ratio_5_63": "CASE WHEN r63 > 1e-8 THEN r5 / r63 END", "vol_z_252": q.zscore("r21", 252),
     "overnight_vs_intraday_21": f"{q.mean('gap', 21)} - {q.mean('idr', 21)}", "roc_126_z": q.zscore("roc_126", 252), "dist_sma_200": f"{q.ratio('close', 's200')} - 1"},
)
register("base_block", q.select(DAY, BASED, BASE, 5))(lambda s, d: shown(blocks.base_block(src.daily(s, d)), DAY, BASED, 5))

PERIODIC = ["ret_1", "ret_4", "dist_sma_10", "dist_sma_30", "rvol_12", "rangepos_26"]
for rule, tag in (("week", "wk"), ("month", "mo")):
    bars_sql = price_queries.SQL[f"bars_{rule}ly"]
    P = q.staged(
        {"ret_1": q.change("close"), "ret_4": q.change("close", 4), "n": "count(*) OVER (PARTITION BY symbol)", "m10": q.mean("close", 10), "m30": q.mean("close", 30), "lo": q.rolled("min", "close", 26, 13), "hi": q.rolled("max", "close", 26, 13)},
        {"dist_sma_10": f"{q.ratio('close', 'm10')} - 1", "dist_sma_30": f"{q.ratio('close', 'm30')} - 1", "rvol_12": q.deviation("ret_1", 12), "rangepos_26": q.clip(q.ratio("close - lo", "hi - lo"), 0.0, 1.0)},
        base="per", head=f"{q.BARS}, per AS ({bars_sql})",
    )
    moved = ", ".join(f"CASE WHEN n >= 40 THEN {q.lag(c)} END AS {tag}_{c}" for c in PERIODIC)
    names = [f"{tag}_{c}" for c in PERIODIC]
    made = (f"{P[0]}, pm AS (SELECT symbol, date, {moved} FROM {P[1]}), j AS (SELECT b.symbol, b.date, {', '.join(names)} FROM bars b ASOF LEFT JOIN pm ON b.symbol = pm.symbol AND b.date >= pm.date)", "j")
    register(f"{rule}ly_block", q.select(DAY, names, made))(lambda s, d, rule=rule, tag=tag, names=names: shown(blocks.period_block(src.daily(s, d), rule, tag), DAY, names))


def _context(tag: str, symbol: str) -> str:
    seen = f"(SELECT b.symbol, b.date, x.close AS seen FROM bars b LEFT JOIN ctx x ON x.symbol = '{symbol}' AND x.date = b.date)"
    return f"c_{tag} AS (SELECT symbol, date, last_value(seen IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS {tag} FROM {seen})"


CTX = {"xu": "1-URGENT", "xh": "2-HIGH", "xm": "3-MEDIUM", "xn": "4-NOT SPECIFIED", "xl": "5-LOW"}
JOINED = " ".join(f"JOIN c_{t} USING (symbol, date)" for t in CTX)
WITH_CTX = f"{q.BARS}, {q.CONTEXT}, {', '.join(_context(t, s) for t, s in CTX.items())}, cx AS (SELECT * FROM bars {JOINED})"


def _beta(x: str, y: str, n: int) -> str:
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    return f"(CASE WHEN count({a}) OVER {q.win(n)} >= {n // 2} THEN {q.ratio(f'covar_samp({a}, {b}) OVER {q.win(n)}', f'var_pop({b}) OVER {q.win(n)}')} END)"


CROSSED = [f"x_{t}_{f}" for t in ("xu", "xh") for f in ("ret_1", "ret_5", "ret_21", "dist_sma50", "beta_63", "corr_63", "rs_21")] + ["x_vix_level", "x_vix_z_252", "x_vix_term"]
CROSS = q.staged(
    {"r": q.change("close"), "r21": q.change("close", 21), "x_vix_level": "xh", "m21": q.mean("xh", 21), "x_vix_z_252": q.zscore("xh", 252)}
    | {f"x_{t}_ret_{n}": q.change(t, n) for t in ("xu", "xh") for n in (1, 5, 21)} | {f"m_{t}": q.mean(t, 50) for t in ("xu", "xh")},
    {f"x_{t}_dist_sma50": f"{q.ratio(t, f'm_{t}')} - 1" for t in ("xu", "xh")} | {f"x_{t}_rs_21": f"r21 - x_{t}_ret_21" for t in ("xu", "xh")} | {"x_vix_term": f"{q.ratio('xh', 'm21')} - 1"}
    | {f"x_{t}_corr_63": q.pair_corr("r", f"x_{t}_ret_1", 63) for t in ("xu", "xh")} | {f"x_{t}_beta_63": _beta("r", f"x_{t}_ret_1", 63) for t in ("xu", "xh")},
    base="cx", head=WITH_CTX,
)
register("cross_block", q.select(DAY, CROSSED, CROSS, 5))(
    lambda s, d: shown(blocks.cross_block(src.daily(s, d), src.context(s, d), {CTX[t]: t for t in ("xu", "xh")}, "xh"), DAY, CROSSED, 5)
)
SHAPE = ["vs_term_9d_1m", "vs_term_9d_1m_z", "vs_backwardation_short", "vs_term_1m_3m", "vs_term_1m_3m_z", "vs_backwardation", "vs_term_slope_chg", "vs_vix_chg_1", "vs_vix_chg_5", "vs_vix_rel_ma21", "vs_vvix_z", "vs_vvix_chg5", "vs_vvix_vix_ratio", "vs_skew_z", "vs_skew_chg5"]
SHAPED = q.staged(
    {"vs_term_9d_1m": "CASE WHEN xu > 1e-9 THEN xh / xu END", "vs_term_1m_3m": "CASE WHEN xm > 1e-9 THEN xu / xm END", "vs_vix_chg_1": f"xu - {q.lag('xu')}", "vs_vix_chg_5": f"xu - {q.lag('xu', 5)}", "m21": q.mean("xu", 21),
     "vs_vvix_z": q.zscore("xn", 252), "vs_vvix_chg5": f"xn - {q.lag('xn', 5)}", "vs_vvix_vix_ratio": "CASE WHEN xu > 1e-9 THEN xn / xu END", "vs_skew_z": q.zscore("xl", 252), "vs_skew_chg5": f"xl - {q.lag('xl', 5)}"},
    {"vs_term_9d_1m_z": q.zscore("vs_term_9d_1m", 252), "vs_backwardation_short": "coalesce(CAST(vs_term_9d_1m > 1 AS DOUBLE), 0.0)", "vs_term_1m_3m_z": q.zscore("vs_term_1m_3m", 252), "vs_backwardation": "coalesce(CAST(vs_term_1m_3m > 1 AS DOUBLE), 0.0)",
     "vs_term_slope_chg": f"vs_term_1m_3m - {q.lag('vs_term_1m_3m', 5)}", "vs_vix_rel_ma21": f"{q.ratio('xu', 'm21')} - 1"},
    base="cx", head=WITH_CTX,
)
register("volatility_structure", q.select(DAY, SHAPE, SHAPED, 4))(
    lambda s, d: shown(blocks.volatility_structure(src.daily(s, d), src.context(s, d), *[CTX[t] for t in ("xu", "xh", "xm", "xn", "xl")]), DAY, SHAPE, 4)
)
for horizon, price, ahead in (("open_next", "open", 1), ("close_next2", "close", 2)):
    before = "date" if ahead == 1 else f"lead(date, {ahead - 1}) OVER {q.SERIES}"
    built = q.staged({"ret": q.change("close"), "nxt": f"lead({price}, {ahead}) OVER {q.SERIES}", "gap": f"date_diff('day', {before}, lead(date, {ahead}) OVER {q.SERIES})"},
                     {"y_ret": f"{q.ratio('nxt', 'close')} - 1", "sd": q.deviation("ret", 21, 10, 1)}, {"raw": f"CASE WHEN sd IS NOT NULL THEN greatest(sd, 1e-4) * sqrt({ahead}) END"},
                     {"sigma": "last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"},
                     {"y_norm": q.clip("y_ret / sigma", -8.0, 8.0), "valid": "y_ret IS NOT NULL AND sigma IS NOT NULL AND coalesce(gap <= 5, FALSE) AND coalesce(abs(y_ret) <= 0.6, FALSE)"})
    register(f"labels_{horizon}", q.select([*DAY, "valid"], ["y_ret", "sigma", "y_norm"], built))(
        lambda s, d, horizon=horizon: shown(labels.build(src.daily(s, d), horizon), [*DAY, "valid"], ["y_ret", "sigma", "y_norm"])
    )
AHEAD5 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
HAR5 = f"{research.HAR}, h5 AS (SELECT symbol, date, har_d, har_w, har_m, CASE WHEN count(rv) OVER {AHEAD5} = 5 THEN ln(sqrt(avg(rv * rv) OVER {AHEAD5})) END AS log_rv_next FROM s3)"
register("har_design_5", q.select(DAY, research.HARS, (HAR5, "h5")))(lambda s, d: shown(trust.har(src.daily(s, d), 5), DAY, research.HARS))
