"""The anchor price as a stream: bars of the session so far, then one row for each symbol and day, both with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import CLOSES, OPENS, ZONE, anchor_price

col = F.col
DAY = 86_400


def anchors(ticks: DataFrame, offset: int = 60, minutes: int = 30, late: str = "90 minutes", symbol: str = "event_type", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """(symbol, date, anchor, partial_volume) of a stream of ticks in UTC: sources.bars.anchors for a session that ends at its usual time.

    Two aggregates in append mode. The first keeps the bars that may still change; the second one row for each symbol and day. A
    day's row comes out, and its state goes, once the watermark is past the end of the bar that holds the anchor's moment: `late` is
    how long a tick may take. Ticks that come after a day's row are left out, missing ones give the last bar before the moment, days with fewer than two
    bars by then have no row. Ticks outside the session, or with a null time, count for nothing. On a plain table all days come out.
    """
    if minutes <= 0 or DAY // 60 % minutes:
        raise ValueError("bars must divide a day")
    cutoff = CLOSES // 60 - offset
    last = cutoff // minutes * minutes  # the bar that holds the moment
    second = lambda c: F.pmod(F.unix_seconds(c), F.lit(DAY))
    # Exchange time as if it were UTC, so that windows of days and bars fall on its clock.
    local = ticks.select(col(symbol).alias("symbol"), F.from_utc_timestamp(col(ts), ZONE).alias("at"), col(value).alias("value"), col(tie).alias("tie"))
    session = local.withWatermark("at", late).where(second(col("at")).between(OPENS, CLOSES) & (second(col("at")) < (last + minutes) * 60))
    order = F.struct("at", "tie")
    bars = session.groupBy(F.window("at", f"{minutes} minutes").alias("w"), "symbol").agg(
        F.min_by("value", order).alias("open"), F.max_by("value", order).alias("close"), F.count("*").alias("volume")
    )
    bars = bars.withColumn("minute", (second(col("w.start")) / 60).cast("int"))
    # Windows of a day that end with the last bar needed, not at midnight: what makes the row come out in time.
    day = F.window(F.window_time("w"), "1 day", startTime=f"{last + minutes} minutes")
    found = bars.groupBy(day.alias("d"), "symbol").agg(
        F.max_by(F.struct("open", "close", "minute"), "minute").alias("bar"), F.sum("volume").alias("partial_volume"), F.count("*").alias("n_bars")
    )
    date = F.date_from_unix_date(F.floor(F.unix_seconds("d.end") / DAY).cast("int"))
    return found.where("n_bars >= 2").select("symbol", date.alias("date"), anchor_price(F.lit(cutoff), minutes).alias("anchor"), "partial_volume")
