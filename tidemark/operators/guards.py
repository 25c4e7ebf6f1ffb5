"""Guards that stop a run: broken bars, missing or non-finite features, leaks, folds that meet, stale quotes.

Each looks at its table in one aggregate job and raises on the driver, naming what is wrong; the tables behind them
(report, overlaps) can be read without raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w
from ..sources import bars as src
from . import features

col = F.col


class DataIntegrityError(ValueError):
    """Bars or features that no result may rest on."""


class LeakageError(ValueError):
    """A feature that knows its label, or folds that share rows."""


class StaleQuoteError(ValueError):
    """A quote too old, or impossible, to act on."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, if it has all the columns; the missing ones are named otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise DataIntegrityError(f"columns are missing: {missing}")
    return df


def require_finite(df: DataFrame, names: list[str], where: str = "table") -> DataFrame:
    """df, if none of the columns has a null, a NaN or an infinite value."""
    bad = lambda c: F.count_if(col(c).isNull() | F.isnan(col(c).cast("double")) | (F.abs(col(c).cast("double")) == float("inf")))
    found = require_columns(df, names).agg(*[bad(c).alias(c) for c in names]).first().asDict()
    if any(found.values()):
        raise DataIntegrityError(f"{where}: not finite in {({k: v for k, v in found.items() if v})}")
    return df


def report(bars: DataFrame, least_rows: int = 100) -> DataFrame:
    """One row per symbol: n_rows, errors and warnings (arrays of names), the largest move and the largest share of nulls.

    Errors: few_rows, repeated_dates, not_positive, high_below_low. Warnings: outside_range, jumps (over a half), nulls (over 5 %
    of a column), no_volume (over 10 %), gaps (over seven days). An order of rows is no matter for a table.
    """
    prices = ["open", "high", "low", "close", "volume"]
    null_share = F.greatest(*[F.avg(col(c).isNull().cast("double")) for c in prices])
    extra = bars.withColumn("__r", w.change(col("close"))).groupBy("symbol").agg(
        F.max(F.abs("__r")).alias("max_abs_return"), null_share.alias("max_null_share"), F.avg((col("volume") <= 0).cast("double")).alias("__zero")
    )
    found = src.validation(bars).join(extra, "symbol")
    named = lambda rules: F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    errors = {"few_rows": col("n_rows") < least_rows, "repeated_dates": col("n_repeated") > 0, "not_positive": col("n_not_positive") > 0, "high_below_low": col("n_inverted") > 0}
    warnings = {
        "outside_range": col("n_outside") > 0, "jumps": col("n_jumps") > 0, "nulls": col("max_null_share") > 0.05, "no_volume": col("__zero") > 0.10,
        "gaps": (col("n_gaps") > 0) & (col("n_rows") > 20),
    }
    return found.select("symbol", "n_rows", named(errors).alias("errors"), named(warnings).alias("warnings"), "max_abs_return", "max_null_share")


def require_valid(bars: DataFrame, least_rows: int = 100) -> DataFrame:
    """bars, if no symbol has an error in its report."""
    bad = report(bars, least_rows).where(F.size("errors") > 0).select("symbol", "errors").orderBy("symbol").limit(5).collect()
    if bad:
        raise DataIntegrityError("; ".join(f"{r['symbol']}: {', '.join(r['errors'])}" for r in bad))
    return bars


def require_no_leak(rows: DataFrame, names: list[str], y: str = "y_ret", least: int = 200, most: float = 0.35) -> DataFrame:
    """rows, if no feature's correlation with the label is too good to be causal."""
    found = features.leak_check(rows, names, y, least, most).where("leak").orderBy(F.abs("corr").desc()).collect()
    if found:
        raise LeakageError("features that know the label: " + ", ".join(f"{r['feature']} ({r['corr']:.2f})" for r in found))
    return rows


def overlaps(parts: DataFrame, purge: int) -> DataFrame:
    """Splits whose train rows reach into the test rows or their purge."""
    return parts.where((col("train_hi") > col("train_lo")) & (col("train_hi") - 1 >= col("test_lo") - purge + 1))


def require_no_overlap(parts: DataFrame, purge: int) -> DataFrame:
    bad = overlaps(parts, purge).orderBy("symbol", "fold").limit(5).collect()
    if bad:
        raise LeakageError("; ".join(f"{r['symbol']}, fold {r['fold']}: train ends at {r['train_hi'] - 1}, test begins at {r['test_lo']}" for r in bad))
    return parts


def require_fresh(quotes: DataFrame) -> DataFrame:
    """quotes with a status (streaming.quotes.fresh), if none is stale or impossible."""
    bad = quotes.where(col("status").isin("stale", "impossible")).limit(5).collect()
    if bad:
        raise StaleQuoteError("; ".join(f"{r['symbol']}: {r['status']}" for r in bad))
    return quotes


def health(rows: DataFrame, footprint: DataFrame, names: list[str], train_end: str | None = None) -> DataFrame:
    """(symbol, date, null_share, outside_share, age_days, warnings) of rows about to be scored.

    footprint(feature, quantiles) is what the model was trained on: a value outside its first and last quantile is new to
    the model. Warnings: empty (over 30 % nulls), outside (over 25 %), old (over 120 days since train_end).
    """
    long = features.long_form(require_columns(rows, names).select("symbol", "date", *[col(n).cast("double").alias(n) for n in names]), names)
    ends = footprint.select("feature", col("quantiles")[0].alias("__lo"), F.element_at("quantiles", -1).alias("__hi"))
    out = long.join(F.broadcast(ends), "feature", "left")  # one row for each feature
    outside = (~col("value").between(col("__lo"), col("__hi"))).cast("double")
    made = out.groupBy("symbol", "date").agg(F.avg(col("value").isNull().cast("double")).alias("null_share"), F.avg(F.coalesce(outside, F.lit(0.0))).alias("outside_share"))
    made = made.withColumn("age_days", F.datediff("date", F.to_date(F.lit(train_end))))
    rules = {"empty": col("null_share") > 0.30, "outside": col("outside_share") > 0.25, "old": col("age_days") > 120}
    return made.withColumn("warnings", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull()))
