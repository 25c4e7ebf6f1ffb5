"""File sources and sinks: bars, prediction tables, result parts, publications."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bars import keep_last

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
#: Provider spellings of the bar columns.
SPELLINGS = {"adj close": "close", "adjclose": "close", "datetime": "date", "ticker": "symbol"}


def normalised(df: DataFrame) -> DataFrame:
    """Lower-case column names in one spelling; an adjusted close gives way where there is a close too; NaN becomes null."""
    names = [c.strip().lower().replace("_", " ") for c in df.columns]
    kept = [(c, SPELLINGS.get(n, n).replace(" ", "_")) for c, n in zip(df.columns, names) if not (n in SPELLINGS and SPELLINGS[n] in names)]
    kinds = dict(df.dtypes)
    clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    return df.select(*[clean(c).alias(n) for c, n in kept])


def read_bars(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Bars by the fixed schema; a missing column is an error."""
    df = normalised(spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path))
    missing = {"symbol", "date", "open", "high", "low", "close", "volume"} - set(df.columns)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    wanted = [x.split() for x in BAR.split(", ")]
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in wanted])


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol, so that a filter on symbols prunes folders."""
    bars.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def look_back(bars: DataFrame, days: int) -> DataFrame:
    """The last `days` calendar days of each symbol."""
    last = F.max("date").over(Window.partitionBy("symbol"))
    return bars.withColumn("__last", last).where(F.datediff("__last", "date") <= days).drop("__last")


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """CSV tables named <symbol>_<anything>.csv, with the symbol from the file name."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return df.withColumn("symbol", F.split(name, "_")[0])


def read_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON result parts in a folder tree; a part that can't be read gives no row."""
    df = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt string").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(folder)
    return df.where(F.col("_corrupt").isNull()).drop("_corrupt")


def merged(previous: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Previous publication with new parts: the new row of a key wins, old keys stay."""
    return previous.join(parts.select(*keys).distinct(), keys, "left_anti").unionByName(parts, allowMissingColumns=True)


def publish(df: DataFrame, path: str) -> None:
    """JSON lines; NaN and infinite doubles become null."""
    kinds = dict(df.dtypes)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c)
    df.select(*[finite(c) if kinds[c] == "double" else F.col(c) for c in df.columns]).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def business_days(spark: SparkSession, first: str, last: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    return days.where(F.weekday("date") < 5)


def read_universe(spark: SparkSession, path: str) -> dict:
    """A universe file (JSON: symbols, and maybe config, variants and overrides) from any store; one without symbols is an error."""
    import json

    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    found = json.loads(text)
    if not found.get("symbols"):
        raise ValueError(f"{path} names no symbols")
    return found


def market(bars: DataFrame, symbols: list[str], context: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(bars of the symbols, bars of the context series, context series without any bar): one scan by partition-prunable filters.

    Of bars of one day the one with the highest `order` stays; without such a column, the last in the order of the files' paths and
    of the rows in them, or, for a table that is not read from files, the largest by its columns. A context series that is
    missing is named, not an error.
    """
    try:
        latest = F.struct("_metadata.file_path", "_metadata.row_index") if order is None else F.col(order)
        one = bars.withColumn("__order", latest)
    except AnalysisException:
        one = bars.withColumn("__order", F.struct(*[c for c in bars.columns if c not in ("symbol", "date")]))
    one = keep_last(one, ["symbol", "date"], ["__order"]).drop("__order")
    own, other = one.where(F.col("symbol").isin(symbols)), one.where(F.col("symbol").isin(context))
    seen = {r["symbol"] for r in other.select("symbol").distinct().collect()}
    return own, other, sorted(set(context) - seen)


def write_result(folder: str, name: str, predictions: DataFrame, figures: DataFrame, lines: list[str]) -> None:
    """One run's results under <folder>/<name>: out-of-sample rows as CSV, figures as JSON lines, a text summary."""
    spark = predictions.sparkSession
    predictions.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}/oos")
    publish(figures, f"{folder}/{name}/figures")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/summary")


def write_manifest(parts: DataFrame, path: str) -> None:
    """parts(symbol, variant, status, ...): what a run made, one JSON line for each part, in order."""
    publish(parts.orderBy("symbol", "variant"), path)


def stored_models(spark: SparkSession, folder: str) -> DataFrame:
    """(base, variant) of the models stored under a folder as <symbol>[__<variant>]."""
    about = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(folder)
    name = F.regexp_extract(F.input_file_name(), "/([^/]+)/about/[^/]*$", 1)
    named = about.select(name.alias("n")).where("n <> ''").distinct()
    cut = F.split("n", "__", 2)
    return named.select(cut[0].alias("base"), F.coalesce(F.get(cut, F.lit(1)), F.lit("close")).alias("variant"))
