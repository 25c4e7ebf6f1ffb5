"""Bar tables: daily and calendar bars, intraday bars, context series, and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONE = "America/New_York"
OPENS, CLOSES = 9 * 3600 + 30 * 60, 16 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last by a total order (dropDuplicates would keep any)."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, high, low, close, volume) from trades, open and close by a total order."""
    trades = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))).alias("px"),
        F.col("l_quantity").alias("qty"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("k"),
    )
    return trades.groupBy("symbol", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"), F.sum("qty").alias("volume"),
    )


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close) of the context series: mean order value by priority and day."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("close")
    )


def period_end(date, rule: str):
    """The Friday a day's week ends on, or the last day of its month."""
    return F.next_day(F.date_sub(date, 1), "FRI") if rule == "week" else F.last_day(date)


def resample(bars: DataFrame, rule: str) -> DataFrame:
    """Calendar bars: first open, highest, lowest, last close, summed volume; empty periods don't appear."""
    return bars.groupBy("symbol", period_end(F.col("date"), rule).alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"),
    )


def intraday(spark: SparkSession, sf_dir: str, minutes: int = 30) -> DataFrame:
    """(symbol, day, minute, open, high, low, close, volume) in exchange time, regular session only."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.col("ts").cast("timestamp_ntz"))
    ticks = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), local.alias("at"), "value", F.struct("ts", "event_id").alias("k")
    )
    second = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")
    session = ticks.withColumn("second", second).where(F.col("second").between(OPENS, CLOSES))
    start = (F.floor(F.col("second") / (60 * minutes)) * minutes).cast("int")
    return session.groupBy("symbol", F.to_date("at").alias("day"), start.alias("minute")).agg(
        F.min_by("value", "k").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", "k").alias("close"), F.count("*").alias("volume"),
    )


def anchor_price(cutoff, minutes: int):
    """The price at minute `cutoff` along the open-to-close line of `bar`."""
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cutoff - F.col("bar.minute")) / F.lit(float(minutes))))
    return F.col("bar.open") * (1 - part) + F.col("bar.close") * part


def anchors(bars: DataFrame, offset: int = 60, minutes: int = 30, close: int | None = None) -> DataFrame:
    """Price `offset` minutes before each day's close, within the last bar that had started by then.

    The price moves along the bar's open-to-close line; days with fewer than two eligible bars have none. The close is the end of
    a day's last bar, or minute `close` of every day, as it is known while the day still runs.
    """
    day = Window.partitionBy("symbol", "day")
    cutoff = F.col("session_end") - offset
    end = F.max(F.col("minute") + minutes).over(day) if close is None else F.lit(close)
    seen = bars.withColumn("session_end", end).where(F.col("minute") <= cutoff)
    last = seen.groupBy("symbol", "day").agg(
        F.max_by(F.struct("open", "close", "minute"), "minute").alias("bar"), F.max("session_end").alias("session_end"),
        F.sum("volume").alias("partial_volume"), F.count("*").alias("n_bars"),
    )
    return last.where("n_bars >= 2").select("symbol", F.col("day").alias("date"), anchor_price(cutoff, minutes).alias("anchor"), "partial_volume")


def validation(bars: DataFrame, jump: float = 0.5, gap_days: int = 7) -> DataFrame:
    """One row per symbol: counts behind the hard checks and the soft warnings, in one pass."""
    w = Window.partitionBy("symbol").orderBy("date")
    prev = F.lag("close").over(w)
    rows = bars.withColumn("ret", F.when(F.abs(prev) > 1e-12, F.col("close") / prev - 1)).withColumn("gap", F.datediff("date", F.lag("date").over(w)))
    out_of_range = lambda c: (F.col(c) > F.col("high") * (1 + 1e-4)) | (F.col(c) < F.col("low") * (1 - 1e-4))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("date")).alias("n_repeated"),
        F.count_if((F.col("open") <= 0) | (F.col("low") <= 0) | (F.col("close") <= 0)).alias("n_not_positive"),
        F.count_if(F.col("high") < F.col("low")).alias("n_inverted"),
        F.count_if(out_of_range("open") | out_of_range("close")).alias("n_outside"),
        F.count_if(F.abs("ret") > jump).alias("n_jumps"), F.count_if(F.col("gap") > gap_days).alias("n_gaps"),
        F.avg(F.when(F.col("volume") == 0, 1.0).otherwise(0.0)).alias("share_no_volume"),
    )


def residual_stats(series: DataFrame) -> DataFrame:
    """(symbol, date, x) -> n, mean, sample sd, lag-1 autocorrelation and 5/95 % quantiles by symbol."""
    rows = series.withColumn("prev", F.lag("x").over(Window.partitionBy("symbol").orderBy("date")))
    both = F.col("x").isNotNull() & F.col("prev").isNotNull()
    x, p = F.when(both, F.col("x")), F.when(both, F.col("prev"))
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    ac = F.covar_pop(x, p) / F.nullif(F.stddev_pop(x) * F.stddev_pop(p), F.lit(0.0))
    return rows.groupBy("symbol").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), ac.alias("ac1"), q[0].alias("q05"), q[1].alias("q95")
    ).withColumn("reliable", F.col("n") >= 30)
