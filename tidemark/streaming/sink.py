"""A journal that a stream writes exactly once, as one folder for each micro-batch.

A batch's rows go to rows/batch=<number>; a line in done/ then says that they are whole. A batch that is done is not written
again, and one that broke off is overwritten by its replay, so a restarted stream leaves no row twice and none out. Nothing is merged
on writing: readers take, of each unit (a day, or whatever is replaced as a whole), the rows of the latest batch that has it.
`compact` writes what a reader sees as a base of its own, after which earlier batches are not read any more.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import keep_last

col = F.col
DONE = "batch bigint, base boolean"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where nothing is set and the master is local."""
    given = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        given = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{given}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """A stored table; empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def done(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, f"{folder}/done", DONE, recursiveFileLookup="true")


def _enter(spark: SparkSession, folder: str, number: int, base: bool) -> None:
    line = spark.range(1).select(F.lit(number).cast("bigint").alias("batch"), F.lit(base).alias("base"))
    line.coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/{'base' if base else 'batch'}-{number}")


def writer(folder: str, keys: tuple[str, ...] = ("date", "symbol"), order: str | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: of rows of one batch with equal keys the one with the highest `order` stays, all without it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not done(spark, folder).where((col("batch") == number) & ~col("base")).isEmpty():
            return
        rows = batch if order is None else keep_last(batch, list(keys), [order])
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        _enter(spark, folder, number, base=False)

    return write


def journal(spark: SparkSession, folder: str, schema: str, unit: tuple[str, ...] = ("date",), keep: int | None = 400, day: str = "date") -> DataFrame:
    """The journal as it is now: of each unit the rows of its latest batch, of the last `keep` days (all without it).

    Rows of a null unit form a unit of their own; rows of batches that are not done are not seen; no batch at all gives an empty table.
    """
    entered = done(spark, folder)
    base = entered.agg(F.max(F.when(col("base"), col("batch")))).first()[0]
    rows = _table(spark, f"{folder}/rows", f"{schema}, batch bigint").join(entered.where(~col("base")).select("batch"), "batch", "left_semi")
    if base is not None:
        old = _table(spark, f"{folder}/base/upto={base}", schema).withColumn("batch", F.lit(base).cast("bigint"))
        rows = rows.where(col("batch") > base).unionByName(old)
    newest = rows.groupBy(*[col(c).alias(f"__{c}") for c in unit]).agg(F.max("batch").alias("__batch"))
    same = col("batch") == col("__batch")
    for c in unit:
        same = same & col(c).eqNullSafe(col(f"__{c}"))
    now = rows.join(newest, same, "left_semi").drop("batch")
    if keep is None:
        return now
    days = now.select(day).distinct().orderBy(col(day).desc_nulls_last()).limit(keep).withColumnRenamed(day, "__day")
    return now.join(days, col(day).eqNullSafe(col("__day")), "left_semi")


def compact(spark: SparkSession, folder: str, schema: str, unit: tuple[str, ...] = ("date",), keep: int | None = 400, day: str = "date") -> None:
    """The journal of all batches that are done as a base; run it while the stream rests between batches or from the stream itself."""
    entered = done(spark, folder)
    upto, base = entered.agg(F.max(F.when(~col("base"), col("batch"))), F.max(F.when(col("base"), col("batch")))).first()
    if upto is None or upto == base:
        return
    journal(spark, folder, schema, unit, keep, day).write.mode("overwrite").parquet(f"{folder}/base/upto={upto}")
    _enter(spark, folder, upto, base=True)
