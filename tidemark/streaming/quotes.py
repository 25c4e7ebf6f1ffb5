"""The live side as Structured Streaming: session-so-far bars and freshness from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the tick files that appear in a folder."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(folder)


def session_bars(stream: DataFrame, width: str = "30 minutes", late: str = "90 minutes") -> DataFrame:
    """Open, last, high, low and count of each symbol and window; ticks later than `late` are left out."""
    order = F.struct("ts", "event_id")
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol"))
        .agg(F.min_by("value", order).alias("open"), F.max_by("value", order).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("volume"), F.max("ts").alias("quoted_at"))
        .select("symbol", F.col("w.start").alias("start"), "open", "last", "high", "low", "volume", "quoted_at")
    )


def fresh(quotes: DataFrame, now, most_minutes: int = 90, warn_minutes: int = 45, previous_close: str | None = None, jump: float = 0.35) -> DataFrame:
    """quotes plus status: stale, impossible, degraded or ok."""
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp("quoted_at")) / 60
    bad = (F.col("last") <= 0) | F.isnan("last") | F.col("last").isNull()
    if previous_close is not None:
        bad = bad | (F.abs(F.col("last") / F.nullif(F.col(previous_close), F.lit(0.0)) - 1) > jump)
    status = F.when(age > most_minutes, "stale").when(F.coalesce(bad, F.lit(False)), "impossible").when(age > warn_minutes, "degraded").otherwise("ok")
    return quotes.withColumn("status", status)
