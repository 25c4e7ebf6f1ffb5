"""Anchor prices against daily bars: rescaling, overlay, live quotes and the row of the day in progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

col = F.col


def rescaled(bars: DataFrame, anchors: DataFrame, least: int = 10) -> DataFrame:
    """bars plus anchor and is_real.

    anchors(symbol, date, anchor, session_close) may be on another scale (unadjusted); the factor is daily close over session
    close where that is sane, carried forward, then back. A symbol with too few common days keeps its closes as anchors.
    """
    both = bars.join(anchors.select("symbol", "date", col("anchor").alias("__a"), col("session_close").alias("__s")), ["symbol", "date"], "left")
    factor = w.ratio(col("close"), col("__s"))
    rows = both.withColumn("__f", F.when((factor > 0.5) & (factor < 2), factor))
    rows = rows.withColumns({"__f": F.coalesce(w.ffill(col("__f")), w.bfill(col("__f")), F.lit(1.0)), "__n": F.count("__f").over(w.Window.partitionBy("symbol"))})
    real = col("__a").isNotNull() & (col("__n") >= least)
    return rows.withColumns({"is_real": real, "anchor": F.when(real, col("__a") * col("__f")).otherwise(col("close"))}).drop("__a", "__s", "__f", "__n")


def coverage(rows: DataFrame) -> DataFrame:
    """(symbol, coverage, mean_bias, sd): share of real anchors and the close's mean distance from them."""
    gap = F.when(col("is_real"), w.ratio(col("close"), col("anchor")) - 1)
    return rows.groupBy("symbol").agg(F.avg(col("is_real").cast("double")).alias("coverage"), F.avg(gap).alias("mean_bias"), F.stddev_samp(gap).alias("sd"))


def first_available(quotes: DataFrame, day) -> DataFrame:
    """quotes(symbol, source, priority, ts, price, volume): the best source of each symbol for a day.

    Open is the first price of the day, last the latest, volume the sum, all from the one source that is taken.
    """
    order = F.struct("ts", "price")
    per = quotes.where(F.to_date("ts") == F.lit(day)).groupBy("symbol", "source", "priority").agg(
        F.min_by("price", order).alias("session_open"), F.max_by("price", order).alias("price"), F.sum("volume").alias("session_volume"), F.max("ts").alias("quoted_at")
    )
    best = F.row_number().over(w.Window.partitionBy("symbol").orderBy("priority", "source"))
    return per.withColumn("__r", best).where("__r = 1").drop("__r").withColumn("degraded", col("priority") > 1)


def with_today(bars: DataFrame, quotes: DataFrame, day) -> DataFrame:
    """bars with one row of the day in progress from first_available(); a day before a symbol's last bar is an error."""
    late = bars.groupBy("symbol").agg(F.max("date").alias("last")).where(col("last") > F.lit(day)).limit(1).collect()
    if late:
        raise ValueError(f"{late[0]['symbol']} already has bars after {day}")
    made = quotes.select(
        "symbol", F.lit(day).cast("date").alias("date"), col("session_open").alias("open"), F.greatest("session_open", "price").alias("high"), F.least("session_open", "price").alias("low"),
        col("price").alias("close"), col("session_volume").cast("double").alias("volume"),
    )
    rest = bars.join(made.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return rest.unionByName(made)


def snapshot(bars: DataFrame, quotes: DataFrame, day, now, names: list[str], most_minutes: int = 90) -> DataFrame:
    """Today's row of each symbol with the TODAY features: the best fresh quote of the day in place of the bar that is not closed yet.

    quotes as in first_available. A quote that is stale or impossible, or a feature that is missing, stops it.
    """
    from ..streaming import quotes as live
    from . import features, guards

    best = first_available(quotes, day).withColumn("last", col("price"))
    guards.require_fresh(live.fresh(best, now, most_minutes))
    rows = with_today(bars, best, day).join(best.select("symbol", F.lit(day).cast("date").alias("date"), col("price").alias("anchor")), ["symbol", "date"], "left")
    made = features.today(rows.withColumn("anchor", F.coalesce("anchor", "close"))).where(col("date") == F.lit(day))
    return guards.require_columns(made, names)
