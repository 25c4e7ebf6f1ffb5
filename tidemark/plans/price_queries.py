"""Queries over daily and intraday bars: resampling, indicators, as-of joins, labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import oscillators as osc
from ..functions import recursive
from ..functions import windows as w
from ..operators import features, labels
from ..sources import bars as src
from ..streaming import anchors as live
from ..streaming import sink
from . import sql as q

QUERIES, SQL = {}, {}
DAY = ["symbol", "date"]


def shown(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Keys and values, values rounded as doubles; adding zero makes -0.0 plain."""
    return df.select(*keys, *[(F.round(F.col(v).cast("double"), digits) + F.lit(0.0)).alias(v) for v in values])


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return keep


def over_bars(name: str, values: list[str], build, *stages: dict[str, str], digits: int = 6) -> None:
    """Register build(daily bars) with the SQL made of stages."""
    register(name, q.select(DAY, values, q.staged(*stages), digits) if stages else None)(
        lambda spark, sf_dir: shown(build(src.daily(spark, sf_dir)), DAY, values, digits)
    )


OHLCV = ["open", "high", "low", "close", "volume"]
register("bars_daily", q.select([*DAY, *OHLCV], [], (f"WITH {q.BARS}", "bars")))(lambda s, d: src.daily(s, d).select(*DAY, *OHLCV))

for rule, end in (("week", "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)"), ("month", "CAST(last_day(date) AS DATE)")):
    grouped = (
        f"WITH {q.BARS}, p AS (SELECT symbol, {end} AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, "
        f"arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, {end})"
    )
    register(f"bars_{rule}ly", q.select([*DAY, *OHLCV], [], (grouped, "p")))(lambda s, d, rule=rule: src.resample(src.daily(s, d), rule).select(*DAY, *OHLCV))

MINUTES = """ticks AS (SELECT event_type AS symbol, timezone('America/New_York', timezone('UTC', ts)) AS lt, value, row(ts, event_id) AS k FROM events),
session AS (SELECT *, hour(lt) * 3600 + minute(lt) * 60 + second(lt) AS sec FROM ticks),
m AS (SELECT symbol, CAST(lt AS DATE) AS day, CAST(sec // 1800 * 30 AS INTEGER) AS minute, arg_min(value, k) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, k) AS close, count(*) AS volume FROM session WHERE sec BETWEEN 34200 AND 57600 GROUP BY 1, 2, 3)"""
register("bars_30m", q.select(["symbol", "day", "minute", "volume"], OHLCV[:4], (f"WITH {MINUTES}", "m")))(
    lambda s, d: shown(src.intraday(s, d), ["symbol", "day", "minute", "volume"], OHLCV[:4])
)
ANCHOR = f"""WITH {MINUTES}, e AS (SELECT *, max(minute + 30) OVER (PARTITION BY symbol, day) - 60 AS cutoff FROM m),
a AS (SELECT symbol, day AS date, arg_max(open, minute) AS o, arg_max(close, minute) AS c, max(minute) AS b, max(cutoff) AS cut, CAST(sum(volume) AS BIGINT) AS partial_volume
  FROM e WHERE minute <= cutoff GROUP BY 1, 2 HAVING count(*) >= 2),
f AS (SELECT *, greatest(0.0, least(1.0, (cut - b) / 30.0)) AS part FROM a),
r AS (SELECT symbol, date, partial_volume, o * (1 - part) + c * part AS anchor FROM f)"""
register("anchor_30m", q.select([*DAY, "partial_volume"], ["anchor"], (ANCHOR, "r")))(
    lambda s, d: shown(src.anchors(src.intraday(s, d)), [*DAY, "partial_volume"], ["anchor"])
)
STREAMED = ANCHOR.replace("max(minute + 30) OVER (PARTITION BY symbol, day) - 60 AS cutoff", "900 AS cutoff").replace(
    "HAVING count(*) >= 2", "HAVING count(*) >= 2 AND day + INTERVAL 930 MINUTE <= (SELECT max(lt) - INTERVAL 90 MINUTE FROM ticks)"
)


@register("anchor_stream", q.select([*DAY, "partial_volume"], ["anchor"], (STREAMED, "r")))
def anchor_stream(spark, sf_dir):
    """Anchors from the table of ticks read as a stream, as far as its watermark gets."""
    out = sink.scratch(spark, "anchors")
    ticks = spark.readStream.schema(src.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")  # a glob: a stream takes no single file
    made = live.anchors(ticks.withColumn("ts", F.col("ts").cast("timestamp")))
    query = made.writeStream.option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start(f"{out}/rows", format="parquet")
    query.awaitTermination()
    return shown(spark.read.schema(made.schema).parquet(f"{out}/rows"), [*DAY, "partial_volume"], ["anchor"])


CHECKS = ["n_rows", "n_repeated", "n_not_positive", "n_inverted", "n_outside", "n_jumps", "n_gaps"]
register(
    "validate_bars",
    q.staged({"ret": q.change("close"), "gap": f"date_diff('day', {q.lag('date')}, date)"})[0]
    + """ SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT date) AS n_repeated, count_if(open <= 0 OR low <= 0 OR close <= 0)::BIGINT AS n_not_positive,
    count_if(high < low)::BIGINT AS n_inverted, count_if(open > high * 1.0001 OR open < low * 0.9999 OR close > high * 1.0001 OR close < low * 0.9999)::BIGINT AS n_outside,
    count_if(abs(ret) > 0.5)::BIGINT AS n_jumps, count_if(gap > 7)::BIGINT AS n_gaps, round(avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_no_volume
    FROM s0 GROUP BY symbol""",
)(lambda s, d: shown(src.validation(src.daily(s, d)), ["symbol", *CHECKS], ["share_no_volume"]))
register(
    "keep_last",
    """SELECT user_id, event_type, event_id, round(value, 6) + 0.0 AS value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)(lambda s, d: shown(src.keep_last(src.table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]), ["user_id", "event_type", "event_id"], ["value"]))

SMA = {f"sma_{n}": q.mean("close", n) for n in (5, 20, 50)}
over_bars(
    "sma_trend", [f"{p}_{n}" for p in ("sma", "dist_sma", "sma_slope") for n in (5, 20, 50)], ind.trend, SMA,
    {f"dist_sma_{n}": f"{q.ratio('close', f'sma_{n}')} - 1" for n in (5, 20, 50)} | {f"sma_slope_{n}": q.change(f"sma_{n}", 5) for n in (5, 20, 50)},
)
over_bars(
    "bollinger_20", ["bb_width_20", "bb_pctb_20"], ind.bollinger, {"m": q.mean("close", 20), "sd": q.deviation("close", 20, 10)},
    {"lo": "m - 2 * sd", "hi": "m + 2 * sd"}, {"bb_width_20": q.ratio("hi - lo", "m"), "bb_pctb_20": q.clip(q.ratio("close - lo", "hi - lo"), -1.0, 2.0)},
)
over_bars(
    "stoch_14", ["stoch_k_14", "stoch_d_14", "willr_14"], ind.stochastic, {"lo": q.rolled("min", "low", 14, 7), "hi": q.rolled("max", "high", 14, 7)},
    {"k": f"100 * {q.ratio('close - lo', 'hi - lo')}"},
    {"stoch_k_14": q.clip("k", 0.0, 100.0), "stoch_d_14": q.clip(q.mean("k", 3, 1), 0.0, 100.0), "willr_14": q.clip(f"-100 * {q.ratio('hi - close', 'hi - lo')}", -100.0, 0.0)},
)
over_bars(
    "cci_20", ["cci_20"], ind.cci, {"tp": "(high + low + close) / 3"}, {"m": q.mean("tp", 20)}, {"dev": "abs(tp - m)"}, {"md": q.mean("dev", 20)},
    {"cci_20": q.clip(q.ratio("tp - m", "0.015 * md"), -500.0, 500.0)}, digits=4,
)
STEP = f"coalesce(sign(close - {q.lag('close')}) * volume, 0.0)"
OBV = {"obv": "sum(step) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"}
over_bars("obv", ["obv"], ind.obv, {"step": STEP}, OBV)
over_bars(
    "mfi_14", ["mfi_14"], ind.mfi, {"tp": "(high + low + close) / 3"}, {"d": f"tp - {q.lag('tp')}"},
    {"up": "CASE WHEN d > 0 THEN tp * volume ELSE 0.0 END", "dn": "CASE WHEN d < 0 THEN tp * volume ELSE 0.0 END"},
    {"a": q.rolled("sum", "up", 14, 7), "b": q.rolled("sum", "dn", 14, 7)}, {"mfi_14": f"coalesce({q.clip('100 - 100 / (1 + ' + q.ratio('a', 'b') + ')', 0.0, 100.0)}, 50.0)"},
)
RET = {"ret": q.change("close")}
YEAR = math.sqrt(252)
over_bars(
    "volatility", [f"{p}_{n}" for p in ("rvol", "dvol") for n in (5, 21, 63)] + ["pvol_21"], ind.volatility, RET,
    {"down": "CASE WHEN ret < 0 THEN ret ELSE 0.0 END", "hl": "pow(ln(high / low), 2)"},
    {f"rvol_{n}": f"{q.deviation('ret', n)} * {YEAR}" for n in (5, 21, 63)} | {f"dvol_{n}": f"{q.deviation('down', n)} * {YEAR}" for n in (5, 21, 63)}
    | {"pvol_21": f"sqrt({q.mean('hl', 21)} / (4 * ln(2))) * {YEAR}"},
)
over_bars(
    "hurst_63", ["hurst_63"], ind.hurst, RET, {"r2": f"ret + {q.lag('ret')}"}, {"v1": q.rolled("var_pop", "ret", 63, 31), "v2": q.rolled("var_pop", "r2", 63, 31)},
    {"hurst_63": q.clip(f"ln({q.ratio('v2', '2 * v1')}) / (2 * ln(2)) + 0.5", 0.0, 1.0)},
)
RANGE = {}
for n in (10, 21, 63):
    RANGE |= {f"lo{n}": q.rolled("min", "close", n, max(3, n // 2)), f"hi{n}": q.rolled("max", "close", n, max(3, n // 2)), f"top{n}": q.rolled("max", "close", n, n // 2)}
over_bars(
    "ranges", [f"{p}_{n}" for p in ("rangepos", "drawdown") for n in (10, 21, 63)], ind.ranges, RANGE,
    {f"rangepos_{n}": q.clip(q.ratio(f"close - lo{n}", f"hi{n} - lo{n}"), 0.0, 1.0) for n in (10, 21, 63)} | {f"drawdown_{n}": f"{q.ratio('close', f'top{n}')} - 1" for n in (10, 21, 63)},
)
over_bars(
    "streak", ["streak"], ind.streak, RET, {"sg": "coalesce(sign(ret), 0.0)"}, {"fresh": f"CASE WHEN sg <> coalesce({q.lag('sg')}, -9.0) THEN 1 ELSE 0 END"},
    {"run": "sum(fresh) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"},
    {"streak": q.clip("sg * row_number() OVER (PARTITION BY symbol, run ORDER BY date)", -10.0, 10.0)},
)
over_bars(
    "volume_block", ["vol_rel_21", "vol_z_63", "obv_slope_21", "dollar_vol_z"], ind.volume_block, {"step": STEP}, OBV,
    {"vm": q.mean("volume", 21), "dv": "close * volume", "o": "abs(obv) + 1"},
    {"vol_rel_21": q.ratio("volume", "vm"), "vol_z_63": q.zscore("volume", 63), "obv_slope_21": q.change("o", 21), "dollar_vol_z": q.zscore("dv", 63)},
)
over_bars(
    "candles", ["candle_body", "upper_wick", "lower_wick", "gap_open", "intraday_ret"], ind.candles,
    {"candle_body": q.ratio("close - open", "high - low"), "upper_wick": q.ratio("high - greatest(open, close)", "high - low"),
     "lower_wick": q.ratio("least(open, close) - low", "high - low"), "gap_open": f"{q.ratio('open', q.lag('close'))} - 1", "intraday_ret": f"{q.ratio('close', 'open')} - 1"},
)
ROC = {f"roc_{n}": q.change("close", n) for n in (1, 5, 21)}
W21, W63 = q.win(21), q.win(63)
over_bars(
    "momentum", ["roc_1", "roc_5", "roc_21", "roc_5_z", "roc_21_z", "ret_skew_21", "ret_kurt_63", "up_days_21"], ind.momentum, ROC, {"up": "coalesce(CAST(roc_1 > 0 AS DOUBLE), 0.0)"},
    {"roc_5_z": q.zscore("roc_5", 252), "roc_21_z": q.zscore("roc_21", 252), "up_days_21": q.mean("up", 21),
     "ret_skew_21": f"CASE WHEN count(roc_1) OVER {W21} >= 10 AND var_pop(roc_1) OVER {W21} > 1e-12 THEN skewness(roc_1) OVER {W21} END",
     "ret_kurt_63": f"CASE WHEN count(roc_1) OVER {W63} >= 30 AND var_pop(roc_1) OVER {W63} > 1e-12 THEN kurtosis(roc_1) OVER {W63} END"},
    digits=5,
)
ON = {}
for n in (5, 21):
    ON |= {f"on_mean_{n}": q.mean("on_ret", n), f"id_mean_{n}": q.mean("id_ret", n), f"on_id_corr_{n}": q.pair_corr("on_ret", "id_ret", n)}
ON |= {"on_vol_21": q.deviation("on_ret", 21), "id_vol_21": q.deviation("id_ret", 21), "on_then_id": "sign(on_ret) * sign(id_ret)",
       "on_streak": q.rolled("sum", "sg_on", 5, 3), "id_streak": q.rolled("sum", "sg_id", 5, 3)}
over_bars(
    "overnight", ["on_ret", "id_ret", *ON, "on_id_spread_5", "on_id_spread_21", "on_id_vol_ratio", "on_then_id_21"], ind.overnight,
    {"on_ret": f"{q.ratio('open', q.lag('close'))} - 1", "id_ret": f"{q.ratio('close', 'open')} - 1"}, {"sg_on": "sign(on_ret)", "sg_id": "sign(id_ret)"}, ON,
    {"on_id_spread_5": "on_mean_5 - id_mean_5", "on_id_spread_21": "on_mean_21 - id_mean_21", "on_id_vol_ratio": q.ratio("on_vol_21", "id_vol_21"), "on_then_id_21": q.mean("on_then_id", 21)},
)
over_bars(
    "calendar", ["cal_dow_sin", "cal_dow_cos", "cal_month_sin", "cal_month_cos", "cal_turn_of_month", "cal_dom_norm", "cal_quarter_end", "cal_week_of_year"], ind.calendar,
    {"cal_dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 5)", "cal_dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 5)",
     "cal_month_sin": "sin(2 * pi() * month(date) / 12)", "cal_month_cos": "cos(2 * pi() * month(date) / 12)",
     "cal_turn_of_month": "CAST(day(date) <= 3 OR day(date) >= 28 AS INTEGER)", "cal_dom_norm": "day(date) / 31.0",
     "cal_quarter_end": "CAST(last_day(date) = date AND month(date) % 3 = 0 AS INTEGER)", "cal_week_of_year": "week(date) / 53.0"},
)


def over_smoothed(name: str, inputs: list[str], values: list[str], build, made: tuple[str, str], digits: int = 6) -> None:
    """Register build(the input columns of daily bars) with SQL that smooths by a recursive query."""
    register(name, q.select(DAY, values, made, digits))(
        lambda spark, sf_dir: shown(build(src.daily(spark, sf_dir).select(*DAY, *inputs)), DAY, values, digits)
    )


PLAIN = (f"WITH {q.BARS}", "bars")
EMAS = {f"ema_{n}": ("close", recursive.span(n), max(2, n // 2)) for n in (12, 26)}
over_smoothed("ema", ["close"], list(EMAS), lambda b: recursive.ema(b, "close", (12, 26)), q.smoothed(PLAIN, EMAS, "e"))
MOVES = q.then(q.then(PLAIN, {"move": f"close - {q.lag('close')}"}, "m0"), {"up": "CASE WHEN move IS NOT NULL THEN greatest(move, 0.0) END", "dn": "CASE WHEN move IS NOT NULL THEN greatest(-move, 0.0) END"}, "m1")
over_smoothed("rsi_14", ["close"], ["rsi_14"], osc.rsi, q.then(
    q.smoothed(MOVES, {"a": ("up", 1 / 14, 14), "b": ("dn", 1 / 14, 14)}, "e"), {"rsi_14": f"coalesce({q.clip('100 - 100 / (1 + ' + q.ratio('a', 'b') + ')', 0.0, 100.0)}, 50.0)"}, "o"))
LINE = q.then(q.smoothed(PLAIN, EMAS, "e"), {"macd": "ema_12 - ema_26"}, "l")
over_smoothed("macd", ["close"], ["macd", "macd_signal", "macd_hist"], osc.macd, q.then(
    q.smoothed(LINE, {"macd_signal": ("macd", recursive.span(9), 9)}, "g"), {"macd_hist": "macd - macd_signal"}, "o"))
TRUE = q.then(PLAIN, {"tr": f"greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')}))"}, "t")
over_smoothed("atr_14", ["high", "low", "close"], ["atr_14"], osc.atr, q.smoothed(TRUE, {"atr_14": ("tr", 1 / 14, 14)}, "e"))
STEPS = q.then(TRUE, {"u": f"high - {q.lag('high')}", "d": f"{q.lag('low')} - low"}, "t1")
STEPS = q.then(STEPS, {"p": "CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END", "m": "CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END"}, "t2")
DI = q.smoothed(STEPS, {"trn": ("tr", 1 / 14, 14), "ps": ("p", 1 / 14, 14), "ms": ("m", 1 / 14, 14)}, "e")
DI = q.then(DI, {"pd": f"100 * {q.ratio('ps', 'trn')}", "md": f"100 * {q.ratio('ms', 'trn')}"}, "t3")
DI = q.then(DI, {"dx": f"100 * {q.ratio('abs(pd - md)', 'pd + md')}"}, "t4")
over_smoothed("adx_14", ["high", "low", "close"], ["adx_14", "pdi_14", "mdi_14"], osc.adx, q.then(
    q.smoothed(DI, {"ax": ("dx", 1 / 14, 14)}, "g"), {"adx_14": q.clip("ax", 0.0, 100.0), "pdi_14": q.clip("pd", 0.0, 100.0), "mdi_14": q.clip("md", 0.0, 100.0)}, "o"))

TODAY = ["tdy_gap", "tdy_anchor_ret", "tdy_anchor_vs_open", "tdy_anchor_dist_sma20", "tdy_anchor_rangepos21", "tdy_anchor_ret_sigma"]
over_bars(
    "today_block", TODAY, features.today, {"anchor": "(open + close) / 2", "prev": q.lag("close"), "ret": q.change("close")},
    {"sma": q.rolled("avg", "close", 20, 10, 1), "hi": q.rolled("max", "high", 21, 10, 1), "lo": q.rolled("min", "low", 21, 10, 1), "sg": q.deviation("ret", 21, 10, 1)},
    {"tdy_gap": f"{q.ratio('open', 'prev')} - 1", "tdy_anchor_ret": f"{q.ratio('anchor', 'prev')} - 1", "tdy_anchor_vs_open": f"{q.ratio('anchor', 'open')} - 1",
     "tdy_anchor_dist_sma20": f"{q.ratio('anchor', 'sma')} - 1", "tdy_anchor_rangepos21": q.clip(q.ratio("anchor - lo", "hi - lo"), -1.0, 2.0),
     "tdy_anchor_ret_sigma": q.clip(q.ratio(f"({q.ratio('anchor', 'prev')} - 1)", "sg"), -10.0, 10.0)},
)
CTX = f"""WITH {q.BARS}, {q.CONTEXT}, own AS (SELECT b.symbol, b.date, b.close, c.close AS seen FROM bars b LEFT JOIN ctx c ON c.symbol = '1-URGENT' AND c.date = b.date),
f AS (SELECT *, last_value(seen IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS ctx_close FROM own)"""
register("context_ffill5", q.select(DAY, ["ctx_close"], (CTX, "f")))(lambda s, d: shown(features.with_context(src.daily(s, d), src.context(s, d), "1-URGENT"), DAY, ["ctx_close"]))
W = q.win(63)
A, B = "(CASE WHEN x IS NOT NULL THEN ret END)", "(CASE WHEN ret IS NOT NULL THEN x END)"
BETA = f"""{CTX}, r AS (SELECT *, {q.change('close')} AS ret, {q.change('ctx_close')} AS x FROM f),
o AS (SELECT *, CASE WHEN count({A}) OVER {W} >= 31 THEN {q.ratio(f'covar_samp({A}, {B}) OVER {W}', f'var_pop({B}) OVER {W}')} END AS beta_63, {q.pair_corr('ret', 'x', 63)} AS corr_63 FROM r)"""
register("beta_corr_63", q.select(DAY, ["beta_63", "corr_63"], (BETA, "o")))(
    lambda s, d: shown(features.cross_asset(features.with_context(src.daily(s, d), src.context(s, d), "1-URGENT")), DAY, ["beta_63", "corr_63"])
)
WEEK = "CAST(date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS DATE)"
ASOF = f"""WITH {q.BARS}, p AS (SELECT symbol, {WEEK} AS date, arg_max(close, date) AS close, max(high) AS high FROM bars GROUP BY symbol, {WEEK}),
p1 AS (SELECT symbol, date, {q.change('close')} AS r1, {q.mean('close', 10)} AS m10, close FROM p),
p2 AS (SELECT symbol, date, lag(r1) OVER {q.SERIES} AS wk_ret_1, lag({q.ratio('close', 'm10')} - 1) OVER {q.SERIES} AS wk_dist_sma_10 FROM p1),
j AS (SELECT b.symbol, b.date, p2.wk_ret_1, p2.wk_dist_sma_10 FROM bars b ASOF LEFT JOIN p2 ON b.symbol = p2.symbol AND b.date >= p2.date)"""
register("weekly_asof", q.select(DAY, ["wk_ret_1", "wk_dist_sma_10"], (ASOF, "j")))(lambda s, d: shown(features.weekly(src.daily(s, d)), DAY, ["wk_ret_1", "wk_dist_sma_10"]))

LABEL = ["y_ret", "sigma", "y_norm", "y_cls"]
LABELS = f"""{q.staged({"ret": q.change("close"), "nxt": f"lead(close) OVER {q.SERIES}", "gap": f"date_diff('day', date, lead(date) OVER {q.SERIES})"}, {"y_ret": f"{q.ratio('nxt', 'close')} - 1", "sg": f"greatest({q.deviation('ret', 21, 10, 1)}, 1e-4)"})[0]},
l AS (SELECT *, CASE WHEN {q.deviation('ret', 21, 10, 1)} IS NOT NULL THEN sg END AS raw FROM s1),
l2 AS (SELECT *, last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS sigma FROM l),
l3 AS (SELECT *, {q.clip('y_ret / sigma', -8.0, 8.0)} AS y_norm, CASE WHEN coalesce(y_ret > 0, FALSE) THEN 1.0 ELSE 0.0 END AS y_cls,
  y_ret IS NOT NULL AND sigma IS NOT NULL AND coalesce(gap <= 5, FALSE) AND coalesce(abs(y_ret) <= 0.6, FALSE) AS valid FROM l2)"""
register("labels_close_next", q.select([*DAY, "valid"], LABEL, (LABELS, "l3")))(lambda s, d: shown(labels.build(src.daily(s, d)), [*DAY, "valid"], LABEL))
register(
    "sample_weights",
    q.select(DAY, ["weight"], (f"""{LABELS}, v AS (SELECT symbol, date, y_ret FROM l3 WHERE valid),
    w AS (SELECT *, exp(-ln(2) * date_diff('day', date, max(date) OVER (PARTITION BY symbol)) / 756.0)
      * greatest(0.25, least(4.0, abs(y_ret) / greatest(median(abs(y_ret)) OVER (PARTITION BY symbol), 1e-8))) AS raw FROM v),
    o AS (SELECT symbol, date, raw / avg(raw) OVER (PARTITION BY symbol) AS weight FROM w)""", "o")),
)(lambda s, d: shown(labels.weights(labels.build(src.daily(s, d)).where("valid")), DAY, ["weight"]))
