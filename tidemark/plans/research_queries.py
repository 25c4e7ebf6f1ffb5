"""Queries of the research layer: backtests, trust statistics, volatility benchmark, journal."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import windows as w
from ..operators import anchoring, backtest, features, journal, labels, models, trust
from ..sources import bars as src
from ..sources import files
from ..streaming import sink
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


def trades(spark, sf_dir):
    return backtest.run(backtest.rule_signals(src.daily(spark, sf_dir)))


RUN = f"""{q.staged({"sma": q.mean("close", 20), "nxt": f"lead(close) OVER {q.SERIES}"}, {"raw": f"{q.ratio('nxt', 'close')} - 1", "side": f"0.25 * sign({q.ratio('close', 'sma')} - 1)"},
    {"y_ret": "CASE WHEN abs(raw) <= 0.6 THEN raw END", "position": f"coalesce({q.lag('side')}, 0.0)"})[0]},
t0 AS (SELECT * FROM s2 WHERE y_ret IS NOT NULL),
t1 AS (SELECT *, abs(position - coalesce({q.lag('position')}, 0.0)) AS turnover, position * y_ret AS gross FROM t0),
t2 AS (SELECT *, turnover * 0.0004 AS cost, gross - turnover * 0.0004 AS net FROM t1),
t3 AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM t2),
trades AS (SELECT *, equity / max(equity) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM t3)"""
DAILY = ["position", "turnover", "cost", "net", "equity", "drawdown"]
register("drawdown", q.select(DAY, DAILY, (RUN, "trades")))(lambda s, d: shown(trades(s, d), DAY, DAILY))

FIGURES = ["sharpe", "sortino", "max_dd", "hit_rate", "directional_accuracy", "profit_factor", "avg_win", "avg_loss", "exposure", "overlap_frac", "autocorr_1", "skew", "kurtosis",
           "worst_day", "best_day", "turnover_mean", "cost_drag_annual", "cagr", "total_return", "vol_annual", "t_stat", "newey_west_factor", "calmar", "sharpe_overlap_adj"]
METRICS = f"""{RUN}, g AS (SELECT *, {q.lag('net')} AS x1, {q.lag('position')} AS p1 FROM trades),
m AS (SELECT symbol, count(*) AS n, count_if(abs(position) > 1e-9)::BIGINT AS n_active, avg(net) AS mu, stddev_samp(net) AS sd,
  CASE WHEN count_if(net < 0) > 2 THEN stddev_samp(net) FILTER (WHERE net < 0) END AS sdd, min(drawdown) AS max_dd, arg_max(equity, date) AS final,
  avg(CAST(net > 0 AS DOUBLE)) FILTER (WHERE abs(position) > 1e-9) AS hit_rate, avg(CAST(sign(position) * sign(y_ret) > 0 AS DOUBLE)) FILTER (WHERE abs(position) > 1e-9) AS directional_accuracy,
  sum(net) FILTER (WHERE net > 0) / abs(sum(net) FILTER (WHERE net < 0)) AS profit_factor, avg(net) FILTER (WHERE net > 0) AS avg_win, avg(net) FILTER (WHERE net < 0) AS avg_loss,
  avg(CAST(abs(position) > 1e-9 AS DOUBLE)) AS exposure, avg(CAST(abs(position) > 1e-9 AND coalesce(abs(p1) > 1e-9, FALSE) AS DOUBLE)) AS overlap_frac,
  corr(net, x1) AS autocorr_1, sum(pow(net, 3)) AS s3, sum(pow(net, 2)) AS s2, sum(net) AS s1, sum(pow(net, 4)) AS s4,
  min(net) AS worst_day, max(net) AS best_day, avg(turnover) AS turnover_mean, avg(cost) * 252 AS cost_drag_annual FROM g GROUP BY symbol),
c AS (SELECT *, s2 / n - mu * mu AS v, s3 / n - 3 * mu * s2 / n + 2 * mu * mu * mu AS c3, s4 / n - 4 * mu * s3 / n + 6 * mu * mu * s2 / n - 3 * pow(mu, 4) AS c4 FROM m),
f AS (SELECT *, c3 / pow(v, 1.5) AS skew, c4 / (v * v) AS kurtosis, mu / sd * {YEAR} AS sharpe, mu / sdd * {YEAR} AS sortino, pow(final, 252.0 / n) - 1 AS cagr, final - 1 AS total_return,
  sd * {YEAR} AS vol_annual, mu / (sd / sqrt(n)) AS t_stat, CASE WHEN abs(autocorr_1) > 1e-6 THEN sqrt(greatest(1e-6, 1 + 2 * autocorr_1 * (1 - 1 / greatest(n, 2)))) ELSE 1.0 END AS newey_west_factor FROM c),
o AS (SELECT *, cagr / abs(max_dd) AS calmar, sharpe / newey_west_factor AS sharpe_overlap_adj FROM f)"""
register("backtest_metrics", q.select(["symbol", "n", "n_active"], FIGURES, (METRICS, "o")))(lambda s, d: shown(backtest.metrics(trades(s, d), ["symbol"]), ["symbol", "n", "n_active"], FIGURES))
YEARS = f"""{RUN}, y AS (SELECT symbol, CAST(year(date) AS INTEGER) AS year, count(*) AS n, product(1 + net) - 1 AS ret, avg(net) / stddev_samp(net) * {YEAR} AS sharpe, avg(CAST(net > 0 AS DOUBLE)) AS hit
FROM trades GROUP BY 1, 2 HAVING count(*) >= 20)"""
register("by_year", q.select(["symbol", "year", "n"], ["ret", "sharpe", "hit"], (YEARS, "y")))(lambda s, d: shown(backtest.by_year(trades(s, d)), ["symbol", "year", "n"], ["ret", "sharpe", "hit"]))
PORT = f"{RUN}, p AS (SELECT date, avg(net) AS net, count(*) AS k FROM trades GROUP BY date), e AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM p)"
register("portfolio", q.select(["date", "k"], ["net", "equity"], (PORT, "e"), 3))(lambda s, d: shown(backtest.portfolio(trades(s, d)), ["date", "k"], ["net", "equity"], 3))
PAIRS = f"{RUN}, c AS (SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.net, y.net) AS corr FROM trades x JOIN trades y ON x.date = y.date AND x.symbol < y.symbol GROUP BY 1, 2)"
register("pair_correlations", q.select(["a", "b", "n"], ["corr"], (PAIRS, "c")))(lambda s, d: shown(backtest.pair_correlations(trades(s, d)), ["a", "b", "n"], ["corr"]))
register("anchor_stress")(lambda s, d: backtest.anchor_stress(trades(s, d), 0.002))
THIN = f"""{RUN}, n AS (SELECT *, row_number() OVER {q.SERIES} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM trades),
o AS (SELECT * FROM n WHERE (rn - 1) % greatest(1, n // 260) = 0 OR rn = n)"""
register("curve_thinned", q.select(DAY, ["equity"], (THIN, "o")))(lambda s, d: shown(backtest.thinned(trades(s, d)), DAY, ["equity"]))


SIDES = "CASE WHEN p >= 0.55 THEN {up} WHEN p <= 1 - 0.55 THEN {down} ELSE 0.0 END"
SIZES = ["continuous", "capped", "long_only", "sided", "confidence", "confidence_capped", "kelly"]


@register("position_sizing", f"""WITH s AS (SELECT doc_id AS id, (doc_id % 101) / 101.0 AS p, (doc_id % 7 - 3) / 1000.0 AS er, (doc_id % 5) / 100.0 AS sg FROM labels),
r AS (SELECT *, (p - 0.5) / 0.5 * 1.5 AS c, {SIDES.format(up="(p - 0.55) / (1 - 0.55)", down="-((1 - 0.55) - p) / (1 - 0.55)")} AS f, {SIDES.format(up="1.0", down="-1.0")} AS b,
  CASE WHEN p >= 0.55 OR p <= 1 - 0.55 THEN er / greatest(sg * sg, 1e-8) * 0.25 ELSE 0.0 END AS k FROM s),
z AS (SELECT id, CASE WHEN abs({q.clip("c", -1.0, 1.0)}) >= 0.02 THEN {q.clip("c", -1.0, 1.0)} ELSE 0.0 END AS continuous, CASE WHEN abs({q.clip("c", -0.35, 0.35)}) >= 0.02 THEN {q.clip("c", -0.35, 0.35)} ELSE 0.0 END AS capped,
  CASE WHEN abs({q.clip("c", 0.0, 1.0)}) >= 0.02 THEN {q.clip("c", 0.0, 1.0)} ELSE 0.0 END AS long_only, b AS sided, {q.clip("f", -1.0, 1.0)} AS confidence, {q.clip("f", -0.35, 0.35)} AS confidence_capped, {q.clip("k", -0.5, 0.5)} AS kelly FROM r)
SELECT id, {", ".join(f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {x}" for x in SIZES)} FROM z""")
def position_sizing(spark, sf_dir):
    p, size = (col("doc_id") % 101) / F.lit(101.0), backtest.position
    expected, sigma = (col("doc_id") % 7 - 3) / F.lit(1000.0), (col("doc_id") % 5) / F.lit(100.0)
    made = {
        "continuous": size(p, gain=1.5), "capped": size(p, gain=1.5, cap=0.35), "long_only": size(p, gain=1.5, short=False), "sided": size(p, "binary"), "confidence": size(p, "confidence"),
        "confidence_capped": size(p, "confidence", cap=0.35), "kelly": size(p, "kelly", leverage=0.5, expected=expected, sigma=sigma),
    }
    return shown(src.table(spark, sf_dir, "labels").select(col("doc_id").alias("id"), *[c.alias(n) for n, c in made.items()]), ["id"], SIZES)


def scores(spark, sf_dir):
    """(y, p): a label and a fixed function of its id as its score."""
    return src.table(spark, sf_dir, "labels").select(col("quality").alias("y"), ((col("doc_id") % 101) / F.lit(101.0)).alias("p"))


SCORES = "WITH scores AS (SELECT quality AS y, (doc_id % 101) / 101.0 AS p FROM labels)"
register("calibration_bins", f"""{SCORES} SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(y), 6) + 0.0 AS rate FROM scores GROUP BY 1 HAVING count(*) >= 5""")(
    lambda s, d: shown(trust.calibration(scores(s, d)), ["bin", "n"], ["mean_p", "rate"])
)
CAL = ["brier", "log_loss", "base_rate", "skill", "ece"]
register("calibration_summary", f"""{SCORES}, c AS (SELECT y, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM scores),
b AS (SELECT count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM c GROUP BY CAST(least(floor(p * 10), 9) AS INTEGER) HAVING count(*) >= 5),
e AS (SELECT sum(n * abs(mp - rate)) AS gap FROM b),
a AS (SELECT count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS log_loss, avg(y) AS base_rate FROM c)
SELECT n, {", ".join(f"round({x}, 6) + 0.0 AS {x}" for x in ("brier", "log_loss", "base_rate"))}, round(1 - brier / (base_rate * (1 - base_rate)), 6) + 0.0 AS skill, round(gap / n, 6) + 0.0 AS ece FROM a, e""")(
    lambda s, d: shown(trust.calibration_summary(scores(s, d)), ["n"], CAL)
)
register("auc_exact", f"""{SCORES}, p AS (SELECT p FROM scores WHERE y = 1), n AS (SELECT p FROM scores WHERE y = 0)
SELECT (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM n) AS n_neg, round(avg(CASE WHEN p.p > n.p THEN 1.0 WHEN p.p = n.p THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS auc FROM p, n""")(
    lambda s, d: shown(trust.auc(scores(s, d)), ["n_pos", "n_neg"], ["auc"])
)
BY_LANG = "WITH g AS (SELECT d.lang, l.quality AS y, (l.doc_id % 101) / 101.0 AS p FROM labels l JOIN documents d USING (doc_id))"
register("auc_by_group", f"""{BY_LANG}, a AS (SELECT x.lang, count(*) AS k, avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0.0 END) AS auc FROM g x JOIN g z ON x.lang = z.lang AND x.y = 1 AND z.y = 0 GROUP BY 1),
n AS (SELECT lang, count_if(y = 1)::BIGINT AS n_pos, count_if(y = 0)::BIGINT AS n_neg FROM g GROUP BY 1) SELECT lang, n_pos, n_neg, round(auc, 6) + 0.0 AS auc FROM n LEFT JOIN a USING (lang)""")(
    lambda s, d: shown(
        trust.auc(src.table(s, d, "labels").join(src.table(s, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", col("quality").alias("y"), ((col("doc_id") % 101) / F.lit(101.0)).alias("p")), ["lang"]),
        ["lang", "n_pos", "n_neg"], ["auc"],
    )
)
STABLE = f"""{YEARS}, f AS (SELECT count(sharpe) AS n, avg(sharpe) AS mean, stddev_samp(sharpe) AS sd, avg(CAST(sharpe > 0 AS DOUBLE)) AS share_positive, min(sharpe) AS worst, max(sharpe) AS best,
  avg(sharpe) / (stddev_samp(sharpe) / sqrt(count(sharpe))) AS t_stat FROM y)"""
STAB = ["mean", "sd", "share_positive", "worst", "best", "t_stat"]
register("fold_stability", q.select(["n"], STAB, (STABLE, "f")))(lambda s, d: shown(trust.fold_stability(backtest.by_year(trades(s, d)), "sharpe"), ["n"], STAB))

SPANS = (5, 10, 15, 20, 30, 40, 50, 60)
PERF = f"""{q.staged({f"m{n}": q.rolled("avg", "close", n, n) for n in SPANS} | {"nxt": f"lead(close) OVER {q.SERIES}", "t": f"row_number() OVER {q.SERIES}"}, {"y": f"{q.ratio('nxt', 'close')} - 1"})[0]},
perf AS ({" UNION ALL ".join(f"SELECT symbol, t - 60 AS t, {n} AS config, sign(close - m{n}) * y AS ret FROM s1 WHERE y IS NOT NULL AND m60 IS NOT NULL" for n in SPANS)}),
b AS (SELECT *, CAST(floor((t - 1) * 8 / count(*) OVER (PARTITION BY symbol, config)) AS INTEGER) AS blk FROM perf),
p AS (SELECT symbol, config, blk, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS ss FROM b GROUP BY 1, 2, 3),
combo AS (SELECT i AS combo FROM range(256) t(i) WHERE bit_count(CAST(i AS INTEGER)) = 4),
x AS (SELECT symbol, combo, config, (combo >> blk) & 1 AS inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM p, combo GROUP BY 1, 2, 3, 4),
sr AS (SELECT symbol, combo, config, inside, CASE WHEN (ss - s * s / n) / (n - 1) > 1e-18 THEN s / n / sqrt((ss - s * s / n) / (n - 1)) ELSE 0.0 END AS sr FROM x),
j AS (SELECT symbol, combo, config, max(sr) FILTER (WHERE inside = 1) AS is_sr, max(sr) FILTER (WHERE inside = 0) AS oos_sr FROM sr GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY symbol, combo ORDER BY oos_sr) + (count(*) OVER (PARTITION BY symbol, combo, oos_sr) - 1) / 2.0 AS rk,
  row_number() OVER (PARTITION BY symbol, combo ORDER BY is_sr DESC, config) AS best FROM j),
l AS (SELECT *, ln(rk / 9.0 / (1 - rk / 9.0)) AS logit FROM r WHERE best = 1),
o AS (SELECT symbol, count(*) AS n_combos, avg(CAST(logit <= 0 AS DOUBLE)) AS pbo, median(logit) AS median_logit, regr_slope(oos_sr, is_sr) AS slope FROM l GROUP BY symbol)"""
PBO = ["pbo", "median_logit", "slope"]
register("pbo_cscv", q.select(["symbol", "n_combos"], PBO, (PERF, "o"), 5))(lambda s, d: shown(trust.pbo(trust.sma_rules(src.daily(s, d))), ["symbol", "n_combos"], PBO, 5))


@register("deflated_sharpe")
def deflated_sharpe(spark, sf_dir):
    """Probability by symbol that its best rule's Sharpe beats the best of as many chance trials as there are rules."""
    perf = trust.sma_rules(src.daily(spark, sf_dir))
    sd = F.stddev_samp("ret")
    each = perf.groupBy("symbol", "config").agg((F.avg("ret") / F.nullif(sd, F.lit(0.0))).alias("sr"), F.count("*").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    best = F.max(F.struct("sr", "n", "skew", "kurt")).alias("best")
    rows = each.groupBy("symbol").agg(best, F.var_samp("sr").alias("variance"), F.count("*").alias("trials"))
    return trust.deflated(rows.select("symbol", "best.*", "variance", "trials"))


@register("block_permutation")
def block_permutation(spark, sf_dir):
    """The next-day returns of each symbol, dealt anew in blocks, beside those in order."""
    rows = labels.build(src.daily(spark, sf_dir))
    moved = trust.block_permute(rows).withColumnRenamed("y_ret", "y_permuted")
    return rows.select(*DAY, "y_ret", (F.row_number().over(w.series()) - 1).alias("__rn")).join(moved, ["symbol", "__rn"]).select(*DAY, "y_ret", "y_permuted")


HAR = f"""{q.staged({"v": f"pow(ln({q.ratio('high', 'low')}), 2) / (4 * ln(2))"}, {"rv": "sqrt(greatest(v, 1e-8))"}, {"log_rv": "ln(rv)"},
    {"har_d": "log_rv", "har_w": q.rolled("avg", "log_rv", 5, 3), "har_m": q.rolled("avg", "log_rv", 22, 10), "log_rv_next": f"lead(log_rv) OVER {q.SERIES}"})[0]}"""
HARS = ["har_d", "har_w", "har_m", "log_rv_next"]
register("har_design", q.select(DAY, HARS, (HAR, "s3")))(lambda s, d: shown(trust.har(src.daily(s, d)), DAY, HARS))
FORE = f"""{HAR}, z AS (SELECT symbol, har_w AS p, har_d AS b, log_rv_next AS y FROM s3 WHERE har_w IS NOT NULL AND har_d IS NOT NULL AND log_rv_next IS NOT NULL),
o AS (SELECT symbol, count(*) AS n, 1 - sum(pow(y - p, 2)) / sum(pow(y - b, 2)) AS r2_oos, avg(exp(2 * (y - p)) - 2 * (y - p) - 1) AS qlike, avg(exp(2 * (y - b)) - 2 * (y - b) - 1) AS qlike_benchmark,
  regr_intercept(y, p) AS mz_alpha, regr_slope(y, p) AS mz_beta, regr_r2(y, p) AS mz_r2 FROM z GROUP BY symbol)"""
FS = ["r2_oos", "qlike", "qlike_benchmark", "mz_alpha", "mz_beta", "mz_r2"]
register("vol_forecast_scores", q.select(["symbol", "n"], FS, (FORE, "o"), 4))(lambda s, d: shown(trust.forecast_scores(trust.har(src.daily(s, d)), "log_rv_next", "har_w", "har_d", ["symbol"]), ["symbol", "n"], FS, 4))
VOLS = ["vol_parkinson", "vol_garman_klass", "vol_rogers_satchell", "vol_yang_zhang"]
RS = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"
register("vol_estimators", q.select(DAY, VOLS, q.staged({"rs": RS, "gap": f"pow(ln({q.ratio('open', q.lag('close'))}), 2)"}, {
    "vol_parkinson": "sqrt(pow(ln(high / low), 2) / (4 * ln(2)))", "vol_garman_klass": "sqrt(greatest(0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2), 0))",
    "vol_rogers_satchell": "sqrt(greatest(rs, 0))", "vol_yang_zhang": "CASE WHEN gap IS NOT NULL THEN sqrt(greatest((gap + pow(ln(close / open), 2) + rs) / 3, 0)) END"})))(
    lambda s, d: shown(trust.bar_variances(src.daily(s, d)), DAY, VOLS)
)


@register("diebold_mariano", q.select(["symbol", "n"], ["mean_d", "dm"], (f"""{HAR}, z AS (SELECT symbol, date, pow(log_rv_next - har_w, 2) - pow(log_rv_next - har_d, 2) AS d FROM s3),
k AS (SELECT * , count(*) OVER (PARTITION BY symbol) AS n, d - avg(d) OVER (PARTITION BY symbol) AS c, row_number() OVER {q.SERIES} AS rn FROM z WHERE d IS NOT NULL),
lg AS (SELECT *, greatest(1, floor(1.5 * pow(n, 1 / 3.0) + 1e-9)) AS most FROM k),
g AS (SELECT a.symbol, a.n, l.i AS lag, sum(a.c * b.c) / a.n AS g FROM lg a JOIN range(60) l(i) ON l.i <= a.most JOIN lg b ON b.symbol = a.symbol AND b.rn = a.rn - l.i GROUP BY 1, 2, 3),
v AS (SELECT symbol, n, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (greatest(1, floor(1.5 * pow(n, 1 / 3.0) + 1e-9)) + 1)) * g END) AS lv FROM g GROUP BY 1, 2),
m AS (SELECT symbol, avg(d) AS mean_d FROM k GROUP BY 1), o AS (SELECT v.symbol, n, mean_d, CASE WHEN n >= 30 THEN mean_d / sqrt(greatest(lv, 1e-12) / n) END AS dm FROM v JOIN m USING (symbol))""", "o"), 5))
def diebold_mariano(spark, sf_dir):
    rows = trust.har(src.daily(spark, sf_dir))
    loss = F.pow(col("log_rv_next") - col("har_w"), 2) - F.pow(col("log_rv_next") - col("har_d"), 2)
    return shown(trust.diebold_mariano(rows.select(*DAY, loss.alias("d"))), ["symbol", "n"], ["mean_d", "dm"], 5)


MOM = ["roc_1", "roc_5", "roc_21", "up_days_21"]
LEAK = f"""{q.staged({f"roc_{n}": q.change("close", n) for n in (1, 5, 21)} | {"nxt": f"lead(close) OVER {q.SERIES}"}, {"y_ret": f"{q.ratio('nxt', 'close')} - 1", "up": "coalesce(CAST(roc_1 > 0 AS DOUBLE), 0.0)"}, {"up_days_21": q.mean("up", 21), "planted": "y_ret * 0.9"})[0]},
u AS (SELECT * FROM s2 UNPIVOT (value FOR feature IN (roc_1, roc_5, roc_21, up_days_21, planted)) WHERE y_ret IS NOT NULL),
o AS (SELECT feature, count(*) AS n, corr(value, y_ret) AS corr FROM u GROUP BY 1)"""


@register("leakage_guard", f"{LEAK} SELECT feature, n, round(corr, 6) + 0.0 AS corr, n >= 200 AND abs(corr) > 0.35 AS leak FROM o")
def leakage_guard(spark, sf_dir):
    rows = ind.momentum(labels.build(src.daily(spark, sf_dir))).withColumn("planted", col("y_ret") * 0.9)
    return shown(features.leak_check(rows, [*MOM, "planted"]), ["feature", "n", "leak"], ["corr"])


FIRST = f"""{q.staged({f"roc_{n}": q.change("close", n) for n in (1, 5, 21)}, {"up": "coalesce(CAST(roc_1 > 0 AS DOUBLE), 0.0)"}, {"up_days_21": q.mean("up", 21)})[0]},
pl AS (SELECT *, row_number() OVER {q.SERIES} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM s2)"""
register("feature_quality", f"""{FIRST}, u AS (SELECT feature, value FROM (SELECT * FROM pl WHERE rn <= greatest(250, floor(0.6 * n))) UNPIVOT INCLUDE NULLS (value FOR feature IN (roc_1, roc_5, roc_21, up_days_21)))
SELECT feature, round(avg(CAST(value IS NOT NULL AS DOUBLE)), 6) + 0.0 AS coverage, round(var_pop(value), 6) + 0.0 AS variance FROM u GROUP BY 1""")(
    lambda s, d: features.feature_quality(ind.momentum(src.daily(s, d)), MOM).select("feature", (F.round("coverage", 6) + F.lit(0.0)).alias("coverage"), (F.round("variance", 6) + F.lit(0.0)).alias("variance"))
)


PAIRWISE = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM s2" for k, a in enumerate(MOM) for b in MOM[k + 1 :])
KEPT = f"""sp(feature, sd) AS ({" UNION ALL ".join(f"SELECT '{m}', stddev_pop({m}) FROM s2" for m in MOM)}), rk AS (SELECT *, row_number() OVER (ORDER BY sd DESC NULLS LAST, feature) AS r FROM sp),
walk(r, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) UNION ALL SELECT k.r, CASE WHEN EXISTS (SELECT 1 FROM pw WHERE abs(pw.corr) >= 0.5 AND (pw.a = k.feature AND list_contains(w.kept, pw.b) OR pw.b = k.feature AND list_contains(w.kept, pw.a)))
  THEN w.kept ELSE list_append(w.kept, k.feature) END FROM walk w JOIN rk k ON k.r = w.r + 1),
fin AS (SELECT kept FROM walk ORDER BY r DESC LIMIT 1)"""


@register("corr_prune", f"""{FIRST.replace("WITH ", "WITH RECURSIVE ", 1)}, pw AS ({PAIRWISE}), {KEPT}
SELECT a, b, round(corr, 6) + 0.0 AS corr, list_contains(kept, a) AS a_kept, list_contains(kept, b) AS b_kept FROM pw, fin""")
def corr_prune(spark, sf_dir):
    rows = ind.momentum(src.daily(spark, sf_dir))
    kept = features.prune_correlated(rows, MOM, 0.5)
    made = features.corr_pairs(rows, MOM).withColumns({"a_kept": col("a").isin(kept), "b_kept": col("b").isin(kept)})
    return shown(made, ["a", "b", "a_kept", "b_kept"], ["corr"])


register("drift", f"""{FIRST}, u AS (SELECT symbol, rn <= floor(0.8 * n) AS early, feature, value FROM pl UNPIVOT INCLUDE NULLS (value FOR feature IN (roc_1, roc_5, roc_21, up_days_21))),
sp AS (SELECT symbol, feature, min(value) AS lo, max(value) AS hi FROM u WHERE early GROUP BY 1, 2), l AS (SELECT u.*, lo, hi FROM u LEFT JOIN sp USING (symbol, feature) WHERE NOT early)
SELECT feature, round(avg(CASE WHEN value IS NOT NULL THEN CAST(NOT (value BETWEEN lo AND hi) AS DOUBLE) END), 6) + 0.0 AS share_outside, round(avg(CAST(value IS NULL AS DOUBLE)), 6) + 0.0 AS share_null FROM l GROUP BY 1""")(
    lambda s, d: shown(trust.drift(ind.momentum(src.daily(s, d)), MOM), ["feature"], ["share_outside", "share_null"])
)


@register("splits_walkforward", f"""WITH {q.BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), k AS (SELECT *, (n - 500) // 8 AS size, CAST(f AS INTEGER) AS fold FROM n, range(8) r(f)),
s AS (SELECT symbol, fold, CAST(0 AS BIGINT) AS train_lo, 500 + fold * size - 7 AS train_hi, 500 + fold * size AS test_lo, CASE WHEN fold = 7 THEN n ELSE 500 + (fold + 1) * size END AS test_hi FROM k WHERE size > 0)
SELECT symbol, fold, train_lo, CAST(train_hi AS BIGINT) AS train_hi, CAST(test_lo AS BIGINT) AS test_lo, CAST(test_hi AS BIGINT) AS test_hi FROM s""")
def splits_walkforward(spark, sf_dir):
    return labels.splits(src.daily(spark, sf_dir))


@register("fold_metrics", f"""WITH {q.BARS}, n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), k AS (SELECT symbol, n, (n - 500) // 8 AS size, CAST(f AS INTEGER) AS fold FROM n, range(8) r(f)),
b AS (SELECT *, row_number() OVER {q.SERIES} - 1 AS rn, lead(close) OVER {q.SERIES} / close - 1 AS y FROM bars)
SELECT b.symbol, k.fold, CASE WHEN rn < 500 + fold * size - 7 THEN 'train' ELSE 'test' END AS role, count(*) AS n, round(avg(y), 6) + 0.0 AS mean_y
FROM b JOIN k ON b.symbol = k.symbol AND size > 0 AND (rn < 500 + fold * size - 7 OR rn >= 500 + fold * size AND rn < CASE WHEN fold = 7 THEN n ELSE 500 + (fold + 1) * size END) GROUP BY 1, 2, 3""")
def fold_metrics(spark, sf_dir):
    rows = labels.build(src.daily(spark, sf_dir))
    joined = labels.membership(rows, labels.splits(rows))
    return shown(joined.groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.avg("y_ret").alias("mean_y")), ["symbol", "fold", "role", "n"], ["mean_y"])


SIG = f"""{q.staged({"lo": q.rolled("min", "close", 21, 10), "hi": q.rolled("max", "close", 21, 10)}, {"pl": q.clip(q.ratio("close - lo", "hi - lo"), 0.0, 1.0)}, {"p": q.lag("pl")})[0]},
sig AS (SELECT symbol, date, 0.6 - 0.2 * p AS prob, (0.6 - 0.2 * p - 0.5) * 2 AS position, close AS anchor FROM s2 WHERE p IS NOT NULL),
nx AS (SELECT symbol, date, lead(date) OVER {q.SERIES} AS exit_date, lead(close) OVER {q.SERIES} AS px FROM bars),
res AS (SELECT s.*, n.exit_date, coalesce(date_diff('day', s.date, n.exit_date) > 5, FALSE) AS skipped, CASE WHEN date_diff('day', s.date, n.exit_date) <= 5 THEN n.px / s.anchor - 1 END AS realized FROM sig s JOIN nx n USING (symbol, date)),
fin AS (SELECT *, CAST((realized > 0) = (prob > 0.5) AS INTEGER) AS correct, position * realized - abs(position) * 0.0008 AS pnl FROM res)"""
RES = ["prob", "position", "realized", "pnl"]


def resolved(spark, sf_dir):
    bars = src.daily(spark, sf_dir)
    return journal.resolve(journal.daily_signals(bars), bars)


register("resolve_signals", q.select([*DAY, "exit_date", "skipped", "correct"], RES, (SIG, "fin")))(lambda s, d: shown(resolved(s, d), [*DAY, "exit_date", "skipped", "correct"], RES))
BOARD = f"""{SIG}, a AS (SELECT *, abs(position) >= 0.05 AS operable FROM fin WHERE pnl IS NOT NULL),
b AS (SELECT operable, symbol, count(*) AS n, avg(correct) AS hit, avg(pnl) AS mean_pnl, sum(pnl) AS sum_pnl, CAST(grouping(operable) * 2 + grouping(symbol) AS BIGINT) AS level FROM a GROUP BY GROUPING SETS ((), (operable), (symbol)))"""
register("scoreboard", q.select(["operable", "symbol", "level", "n"], ["hit", "mean_pnl", "sum_pnl"], (BOARD, "b")))(
    lambda s, d: shown(journal.scoreboard(resolved(s, d)), ["operable", "symbol", "level", "n"], ["hit", "mean_pnl", "sum_pnl"])
)


@register("journal_upsert", f"""{SIG}, old AS (SELECT date, symbol, prob FROM sig WHERE date < DATE '2001-06-01'), new AS (SELECT date, symbol, prob + 0.01 AS prob FROM sig WHERE date >= DATE '2001-05-01'),
u AS (SELECT * FROM old WHERE date NOT IN (SELECT date FROM new) UNION ALL SELECT * FROM new), dd AS (SELECT DISTINCT date FROM u ORDER BY date DESC LIMIT 400)
SELECT date, symbol, round(prob, 6) + 0.0 AS prob FROM u WHERE date IN (SELECT date FROM dd)""")
def journal_upsert(spark, sf_dir):
    signals = journal.daily_signals(src.daily(spark, sf_dir)).select("date", "symbol", "prob")
    old = signals.where("date < DATE '2001-06-01'")
    new = signals.where("date >= DATE '2001-05-01'").withColumn("prob", col("prob") + 0.01)
    return shown(journal.upsert(old, new), ["date", "symbol"], ["prob"])


@register("journal_sink", SQL["journal_upsert"])
def journal_sink(spark, sf_dir):
    """The upsert as batches of a stream's sink, the last of them delivered twice."""
    signals = journal.daily_signals(src.daily(spark, sf_dir)).select("date", "symbol", "prob")
    folder = sink.scratch(spark, "journal")
    write = sink.writer(folder)
    new = signals.where("date >= DATE '2001-05-01'").withColumn("prob", col("prob") + 0.01)
    for number, batch in enumerate([signals.where("date < DATE '2001-06-01'"), new]):
        write(batch, number)
    write(new, 1)
    return shown(sink.journal(spark, folder, "date date, symbol string, prob double"), ["date", "symbol"], ["prob"])


register("journal_entries", f"""{SIG} SELECT date, to_json(list({{'symbol': symbol, 'prob': round(prob, 4)}} ORDER BY prob DESC, symbol))::VARCHAR AS signals FROM sig GROUP BY date""")(
    lambda s, d: journal.entries(journal.daily_signals(src.daily(s, d))).select("date", F.to_json(F.transform("signals", lambda x: F.struct(x["symbol"].alias("symbol"), F.round(x["prob"], 4).alias("prob")))).alias("signals"))
)
WIN = f"{YEARS}, r AS (SELECT symbol AS base, CAST(year AS VARCHAR) AS variant, CASE WHEN sharpe > 0.5 THEN 2 WHEN sharpe > 0 THEN 1 ELSE 0 END AS verdict_rank, hit - 0.5 AS edge FROM y)"
register("variant_winner", f"{WIN} SELECT base, variant, CAST(verdict_rank AS INTEGER) AS verdict_rank, round(edge, 6) + 0.0 AS edge FROM r QUALIFY row_number() OVER (PARTITION BY base ORDER BY verdict_rank DESC, edge DESC NULLS LAST, variant) = 1")(
    lambda s, d: shown(journal.winners(backtest.by_year(trades(s, d)).select(col("symbol").alias("base"), col("year").cast("string").alias("variant"), F.when(col("sharpe") > 0.5, 2).when(col("sharpe") > 0, 1).otherwise(0).alias("verdict_rank"), (col("hit") - 0.5).alias("edge"))), ["base", "variant", "verdict_rank"], ["edge"])
)


@register("verdict", f"""{METRICS}, k AS (SELECT symbol, CAST(NOT coalesce(sharpe > 0.5, FALSE) AS INTEGER) + CAST(NOT coalesce(max_dd > -0.3, FALSE) AS INTEGER) + CAST(NOT coalesce(hit_rate > 0.5, FALSE) AS INTEGER) AS n_failed FROM o)
SELECT symbol, n_failed, CASE WHEN n_failed = 0 THEN 'GO' WHEN n_failed <= 2 THEN 'REVISE' ELSE 'NO-GO' END AS verdict FROM k""")
def verdict(spark, sf_dir):
    figures = backtest.metrics(trades(spark, sf_dir), ["symbol"])
    checks = {"sharpe": (col("sharpe") > 0.5, True), "drawdown": (col("max_dd") > -0.3, True), "hit rate": (col("hit_rate") > 0.5, True), "active days": (col("n_active") > 250, False)}
    return journal.verdict(figures, checks).select("symbol", "n_failed", "verdict")


register("json_roundtrip", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(
    lambda s, d: src.table(s, d, "events").select("event_id", F.from_json(F.to_json(F.from_json("props", "k bigint")), "k bigint")["k"].alias("k"))
)
RSTAT = f"""{q.staged({"x": q.change("close")}, {"x1": q.lag("x")})[0]}, o AS (SELECT symbol, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, corr(x, x1) AS ac1, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.95) AS q95, count(x) >= 30 AS reliable FROM s1 GROUP BY symbol)"""
RS_COLS = ["mean", "sd", "ac1", "q05", "q95"]
register("residual_stats", q.select(["symbol", "n", "reliable"], RS_COLS, (RSTAT, "o")))(
    lambda s, d: shown(src.residual_stats(src.daily(s, d).withColumn("x", w.change(col("close")))), ["symbol", "n", "reliable"], RS_COLS)
)
CP = f"""{q.staged({"nxt": f"lead(close) OVER {q.SERIES}"}, {"y_ret": f"{q.ratio('nxt', 'close')} - 1", "position": f"sign({q.ratio('open', q.lag('close'))} - 1)"})[0]}, t0 AS (SELECT *, coalesce(position, 0.0) AS pos FROM s1 WHERE y_ret IS NOT NULL),
t1 AS (SELECT *, pos * y_ret - abs(pos - coalesce({q.lag('pos')}, 0.0)) * 0.0004 AS net FROM t0)"""
register("cont_pnl", q.select(DAY, ["net"], (CP, "t1")))(
    lambda s, d: shown(backtest.continuous_pnl(src.daily(s, d).withColumn("position", F.coalesce(F.signum(w.ratio(col("open"), w.lag(col("close"))) - 1), F.lit(0.0)))), DAY, ["net"])
)


def _gram():
    terms = {"1": "1.0", "d": "har_d", "w": "har_w", "m": "har_m"}
    sums = ", ".join(f"sum({a} * {b}) AS g_{i}{j}" for i, a in terms.items() for j, b in terms.items()) + ", " + ", ".join(f"sum({a} * log_rv_next) AS b_{i}" for i, a in terms.items())
    return f"SELECT symbol, {sums} FROM s3 WHERE har_d IS NOT NULL AND har_w IS NOT NULL AND har_m IS NOT NULL AND log_rv_next IS NOT NULL GROUP BY symbol"


def _eliminated():
    """Gauss-Jordan elimination of the four normal equations, one step a table."""
    n, steps = "1dwm", []
    last = "n0"
    for k, p in enumerate(n):
        g = lambda i, j: f"g_{i}{j}"
        row = [f"{g(p, j)} / {g(p, p)} AS g_{p}{j}" for j in n] + [f"b_{p} / {g(p, p)} AS b_{p}"]
        rest = [f"{g(i, j)} - {g(i, p)} * {g(p, j)} / {g(p, p)} AS g_{i}{j}" for i in n if i != p for j in n] + [f"b_{i} - {g(i, p)} * b_{p} / {g(p, p)} AS b_{i}" for i in n if i != p]
        steps.append(f"n{k + 1} AS (SELECT symbol, {', '.join(row + rest)} FROM {last})")
        last = f"n{k + 1}"
    return f"n0 AS ({_gram()}), {', '.join(steps)}"


@register("har_coefficients", f"""{HAR}, {_eliminated()} SELECT symbol, term, round(value, 4) + 0.0 AS value FROM (SELECT symbol, b_1 AS const, b_d AS day, b_w AS week, b_m AS month FROM n4) UNPIVOT (value FOR term IN (const, day, week, month))""")
def har_coefficients(spark, sf_dir):
    """(symbol, term, value): the HAR regression of each symbol."""
    found = models.har_ols(trust.har(src.daily(spark, sf_dir)))
    return shown(found.unpivot(["symbol"], ["const", "day", "week", "month"], "term", "value"), ["symbol", "term"], ["value"], 4)


def fold_rows(spark, sf_dir, **options):
    """Daily rows with causal momentum features, labels, weights, folds and roles."""
    bars = ind.momentum(labels.build(src.daily(spark, sf_dir)))
    rows = labels.weights(features.shift_base(bars, MOM).where("valid"))
    return labels.membership(rows, labels.splits(rows, least_train=200, **options))


@register("walk_forward_model")
def walk_forward_model(spark, sf_dir):
    """Out-of-sample probabilities on every test row of every fold: three families, calibrated, stacked, calibrated again."""
    return models.walk_forward(fold_rows(spark, sf_dir), MOM)[0]


TERM = f"""WITH {q.BARS}, {q.CONTEXT}, own AS (SELECT b.symbol, b.date, x.close AS sa, y.close AS sb FROM bars b LEFT JOIN ctx x ON x.symbol = '1-URGENT' AND x.date = b.date LEFT JOIN ctx y ON y.symbol = '2-HIGH' AND y.date = b.date),
f AS (SELECT *, last_value(sa IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a, last_value(sb IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS b FROM own),
r AS (SELECT *, {q.ratio('a', 'b')} AS vs_term FROM f),
o AS (SELECT *, {q.zscore('vs_term', 252)} AS vs_term_z, coalesce(CAST(vs_term > 1 AS DOUBLE), 0.0) AS vs_backwardation, vs_term - {q.lag('vs_term')} AS vs_term_chg, {q.change('a', 5)} AS vs_chg_5 FROM r)"""
VS = ["vs_term", "vs_term_z", "vs_backwardation", "vs_term_chg", "vs_chg_5"]
register("term_structure", q.select(DAY, VS, (TERM, "o")))(lambda s, d: shown(features.term_structure(src.daily(s, d), src.context(s, d), "1-URGENT", "2-HIGH"), DAY, VS))
YZK = 0.34 / (1.34 + 22 / 20)
register("yang_zhang_21", q.select(DAY, ["yz_21"], q.staged(
    {"gap": f"ln({q.ratio('open', q.lag('close'))})", "oc": "ln(close / open)", "rs": RS},
    {"v": f"{q.rolled('var_samp', 'gap', 21, 10)} + {YZK} * {q.rolled('var_samp', 'oc', 21, 10)} + {1 - YZK} * {q.rolled('avg', 'rs', 21, 10)}"}, {"yz_21": "CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 0)) END"})))(
    lambda s, d: shown(trust.yang_zhang(src.daily(s, d)), DAY, ["yz_21"])
)
register("permutation_test")(lambda s, d: trust.permutation_test(backtest.rule_signals(src.daily(s, d))))
FOOT = f"""{q.staged({f"roc_{n}": q.change("close", n) for n in (1, 5, 21)})[0]}, u AS (SELECT * FROM s0 UNPIVOT (value FOR feature IN (roc_1, roc_5, roc_21))),
o AS (SELECT feature, quantile_cont(value, 0.1) AS d10, quantile_cont(value, 0.5) AS d50, quantile_cont(value, 0.9) AS d90 FROM u GROUP BY 1)"""
register("footprint", q.select(["feature"], ["d10", "d50", "d90"], (FOOT, "o")))(
    lambda s, d: shown(trust.footprint(ind.momentum(src.daily(s, d)), MOM[:3]).select("feature", *[col("quantiles")[k].alias(f"d{10 * k}") for k in (1, 5, 9)]), ["feature"], ["d10", "d50", "d90"])
)
RESC = f"""WITH {q.BARS}, a AS (SELECT symbol, date, open / 0.984 AS anchor, close / 0.984 AS sc FROM bars WHERE day(date) % 3 <> 0),
j AS (SELECT b.*, a.anchor AS a, {q.ratio('b.close', 'a.sc')} AS f0 FROM bars b LEFT JOIN a USING (symbol, date)),
f AS (SELECT *, coalesce(last_value(f0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), first_value(f0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS f FROM j),
o AS (SELECT symbol, date, a IS NOT NULL AS is_real, CASE WHEN a IS NOT NULL THEN a * f ELSE close END AS anchor FROM f)"""


@register("anchor_rescaled", q.select([*DAY, "is_real"], ["anchor"], (RESC, "o"), 9))
def anchor_rescaled(spark, sf_dir):
    """Anchors from a series on another scale, on two of three days."""
    bars = src.daily(spark, sf_dir)
    other = bars.where(F.day("date") % 3 != 0).select(*DAY, (col("open") / 0.984).alias("anchor"), (col("close") / 0.984).alias("session_close"))
    return shown(anchoring.rescaled(bars, other), [*DAY, "is_real"], ["anchor"], 9)


BACK = f"WITH {q.BARS}, o AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS m FROM bars)"
register("look_back_730", f"{BACK} SELECT symbol, date, close FROM o WHERE date_diff('day', date, m) <= 730")(lambda s, d: files.look_back(src.daily(s, d), 730).select(*DAY, "close"))
SEQ = f"""{q.staged({"r": q.change("close")}, {"x": "coalesce(r, 0.0)"})[0]}, o AS (SELECT symbol, date, list(x) OVER {q.win(5)} AS l, count(*) OVER {q.win(5)} AS k FROM s1)
SELECT symbol, date, round(l[1], 6) + 0.0 AS oldest, round(l[k], 6) + 0.0 AS newest, 5 AS n_steps FROM o"""


@register("sequence_windows", SEQ)
def sequence_windows(spark, sf_dir):
    rows = ind.returns(src.daily(spark, sf_dir)).withColumn("x", F.coalesce("ret", F.lit(0.0)))
    made = features.sequences(rows, ["x"], 5)
    return shown(made.select(*DAY, F.size("steps").alias("n_steps"), col("steps")[0][0].alias("oldest"), col("steps")[4][0].alias("newest")), [*DAY, "n_steps"], ["oldest", "newest"])


ROLL = f"""{YEARS}, r AS (SELECT year, count(*) AS n, avg(sharpe) AS mean_sharpe, count_if(sharpe > 0)::BIGINT AS n_positive, string_agg(symbol, ',' ORDER BY symbol) FILTER (WHERE sharpe > 0) AS symbols FROM y GROUP BY 1)"""
register("rollup_by_year", q.select(["year", "n", "n_positive", "symbols"], ["mean_sharpe"], (ROLL, "r")))(
    lambda s, d: shown(
        backtest.by_year(trades(s, d)).groupBy("year").agg(
            F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.count_if(col("sharpe") > 0).alias("n_positive"),
            F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(col("sharpe") > 0, col("symbol")))), ","), F.lit("")).alias("symbols"),
        ), ["year", "n", "n_positive", "symbols"], ["mean_sharpe"],
    )
)
