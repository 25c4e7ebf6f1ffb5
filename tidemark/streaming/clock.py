"""The market's clock as columns, and signals that wait for the next close as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bars import CLOSES, OPENS, ZONE

col = F.col


def with_clock(rows: DataFrame, ts: str = "ts", offset: int = 60, slack: int = 10) -> DataFrame:
    """rows plus day, minutes_to_close, in_session, late, early and last_closed of a UTC time, in exchange time.

    late and early: over `slack` minutes past or before `offset` minutes to the close, the moment models are trained for. last_closed:
    the last day whose session is over. Holidays show as days without data, not here.
    """
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), col(ts).cast("timestamp_ntz"))
    out = rows.withColumn("__at", local).withColumn("day", F.to_date("__at"))
    second = F.hour("__at") * 3600 + F.minute("__at") * 60 + F.floor(F.second("__at"))
    weekday = F.weekday("__at") < 5
    left = (CLOSES - second) / F.lit(60.0)
    return out.withColumns(
        {
            "minutes_to_close": left, "in_session": weekday & (second >= OPENS) & (left >= 0), "late": left - offset < -slack, "early": left - offset > slack,
            "last_closed": F.when((left <= 0) | ~weekday, col("day")).otherwise(F.date_sub("day", 1)),
        }
    ).drop("__at")


def at_anchor(ticks: DataFrame, ts: str = "ts", offset: int = 60) -> DataFrame:
    """Ticks at or after the anchor moment of their session: what a stream waits for before it acts."""
    return with_clock(ticks, ts, offset).where(col("in_session") & (col("minutes_to_close") <= offset))


def closed_bars(bars: DataFrame, now, date: str = "date") -> DataFrame:
    """Bars of sessions that are over at `now` (UTC): the bar of the day in progress is left out."""
    moment = with_clock(bars.sparkSession.range(1).select(F.lit(now).cast("timestamp").alias("__now")), "__now").first()
    return bars.where(col(date) <= F.lit(moment["last_closed"]))


def pending(signals: DataFrame, closes: DataFrame, most_days: int = 5, round_trip_bps: float = 8.0) -> DataFrame:
    """Streams of signals(symbol, ts, prob, position, anchor) and closes(symbol, close_ts, close): each signal with every close of its
    symbol within `most_days` after it, as soon as that close arrives; first_close keeps the first.

    An interval join: both sides keep state only as long as the watermarks and the interval ask for.
    """
    s = signals.withWatermark("ts", "1 day").select(*[col(c).alias(c) for c in ("symbol", "ts", "prob", "position", "anchor")])
    c = closes.withWatermark("close_ts", "1 day").select(col("symbol").alias("__symbol"), "close_ts", "close")
    on = (col("symbol") == col("__symbol")) & (col("close_ts") > col("ts")) & (col("close_ts") <= col("ts") + F.expr(f"INTERVAL {most_days} DAYS"))
    joined = s.join(c, on).drop("__symbol")
    realized = col("close") / F.nullif(col("anchor"), F.lit(0.0)) - 1
    made = joined.withColumn("realized", realized)
    return made.withColumns(
        {"correct": ((col("realized") > 0) == (col("prob") > 0.5)).cast("int"), "pnl": col("position") * col("realized") - F.abs("position") * (round_trip_bps / 1e4)}
    )


def first_close(resolved: DataFrame) -> DataFrame:
    """Of a signal's resolved rows the one of the first close: for the table the stream writes."""
    return resolved.groupBy("symbol", "ts").agg(F.min_by(F.struct("close_ts", "close", "realized", "correct", "pnl"), "close_ts").alias("r")).select("symbol", "ts", "r.*")
