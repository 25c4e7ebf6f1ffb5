"""Signal journal: publication, upsert, reconciliation against later prices, scoreboards and variant choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as w

col = F.col


def daily_signals(bars: DataFrame) -> DataFrame:
    """(symbol, date, prob, position, anchor): a deterministic score of yesterday's place in the range of closes."""
    rows = bars.withColumns({"__lo": w.lowest(col("close"), 21, 10), "__hi": w.highest(col("close"), 21, 10)})
    rows = rows.withColumn("__p", w.lag(w.clip(w.ratio(col("close") - col("__lo"), col("__hi") - col("__lo")), 0.0, 1.0)))
    made = rows.where(col("__p").isNotNull()).withColumn("prob", 0.6 - 0.2 * col("__p"))
    return made.select("symbol", "date", "prob", ((col("prob") - 0.5) * 2).alias("position"), col("close").alias("anchor"))


def resolve(signals: DataFrame, bars: DataFrame, max_gap: int = 5, round_trip_bps: float = 8.0) -> DataFrame:
    """signals plus the first close after each signal's day: exit_date, realized, correct, pnl, or skipped.

    Signals and closes are united and read backwards once by symbol: no range join.
    """
    closes = bars.select("symbol", "date", F.struct(col("date").alias("d"), col("close").alias("c")).alias("__bar"), F.lit(None).cast(signals.select(F.struct(*signals.columns)).schema[0].dataType).alias("__row"))
    rows = signals.select("symbol", "date", F.lit(None).cast(closes.schema["__bar"].dataType).alias("__bar"), F.struct(*signals.columns).alias("__row"))
    # Within a day the bar comes before the signal, so that a signal sees later days only.
    after = Window.partitionBy("symbol").orderBy("date", col("__bar").isNull()).rowsBetween(1, Window.unboundedFollowing)
    found = closes.unionByName(rows).withColumn("__next", F.first("__bar", ignorenulls=True).over(after)).where(col("__row").isNotNull())
    out = found.select("__row.*", col("__next.d").alias("exit_date"), (w.ratio(col("__next.c"), col("__row.anchor")) - 1).alias("realized"))
    late = F.datediff("exit_date", "date") > max_gap
    ok = col("exit_date").isNotNull() & ~late
    return out.withColumns(
        {
            "skipped": col("exit_date").isNotNull() & late, "realized": F.when(ok, col("realized")),
            "correct": F.when(ok, ((col("realized") > 0) == (col("prob") > 0.5)).cast("int")),
            "pnl": F.when(ok, col("position") * col("realized") - F.abs("position") * (round_trip_bps / 1e4)),
        }
    )


def scoreboard(resolved: DataFrame, least_position: float = 0.05) -> DataFrame:
    """Overall, operable and by-symbol figures as grouping sets over one scan."""
    rows = resolved.where(col("pnl").isNotNull()).withColumn("operable", F.abs("position") >= least_position)
    return rows.groupingSets([[], [col("operable")], [col("symbol")]], col("operable"), col("symbol")).agg(
        F.count("*").alias("n"), F.avg(col("correct").cast("double")).alias("hit"), F.avg("pnl").alias("mean_pnl"), F.sum("pnl").alias("sum_pnl"), F.grouping_id().alias("level")
    )


def upsert(journal: DataFrame, entries: DataFrame, keep: int = 400) -> DataFrame:
    """journal without the days of entries, plus entries, the last `keep` days of it."""
    rest = journal.join(entries.select("date").distinct(), "date", "left_anti")
    both = rest.unionByName(entries)
    days = both.select("date").distinct().withColumn("__r", F.row_number().over(Window.orderBy(col("date").desc()))).where(col("__r") <= keep).drop("__r")
    return both.join(F.broadcast(days), "date", "left_semi")  # at most `keep` days


def entries(signals: DataFrame) -> DataFrame:
    """(date, signals): one row a day, its signals as structs by falling probability."""
    ranked = F.struct((-col("prob")).alias("o"), col("symbol").alias("s"), F.struct("symbol", "prob", "position").alias("signal"))
    return signals.groupBy("date").agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["signal"]).alias("signals"))


def winners(results: DataFrame) -> DataFrame:
    """results(base, variant, verdict_rank, edge): the best variant of each base, nulls last, ties by name."""
    by = Window.partitionBy("base").orderBy(col("verdict_rank").desc(), col("edge").desc_nulls_last(), "variant")
    return results.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def verdict(metrics: DataFrame, checks: dict[str, tuple], most_failed: int = 2) -> DataFrame:
    """metrics plus checks (array of structs) and verdict: GO, REVISE with few failed critical checks, else NO-GO."""
    made = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed"), F.lit(critical).alias("critical")) for n, (c, critical) in checks.items()])
    out = metrics.withColumn("checks", made)
    failed = F.size(F.filter("checks", lambda c: c["critical"] & ~c["passed"]))
    return out.withColumn("n_failed", failed).withColumn("verdict", F.when(failed == 0, "GO").when(failed <= most_failed, "REVISE").otherwise("NO-GO"))
