"""Helpers shared by the corpus operators: word splitting, row ids, shared checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters; a word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Array of words; empty for null, empty or blank text."""
    bare = strip_space(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. A temporary one only on a local master (tests); elsewhere none is an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    set_already = spark.sparkContext.getCheckpointDir()
    if given:
        if not set_already:
            spark.sparkContext.setCheckpointDir(given)
        return given
    if not set_already:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    For wide rows that several jobs read, and for loops: the size of what is read back is known, while
    checkpoints carry estimates on, and those of a loop of joins multiply without end.
    """
    path = path or f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the caller's table does not use."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_id(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs plus a column that names each row, ids and texts notwithstanding, and that column's name.

    A row is named by its file and its place in it, so docs read from files can be read twice; other tables
    are stored once first.
    """
    name = free_name(docs, "rid")
    place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index"))
    try:
        return docs.withColumn(name, place), name
    except AnalysisException:
        return stored(docs).withColumn(name, place), name


def hot_keys(counts: DataFrame, key: str, n: str = "n", total: int | None = None, least: int = 100, share: int = 1000) -> DataFrame:
    """Keys of a (key, n) table that hold over 1/share of all n, and over `least`: fewer than `share` of them.

    total: the sum of n, or about that, where it is known.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    return counts.where(F.col(n) > max(least, total // share)).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, how: str = "left", salts: int = 64) -> DataFrame:
    """left joined with right, where left's rows of hot keys are dealt over `salts` tasks and right's repeated.

    hot(key) comes from hot_keys and is small; right has few rows for each key. The salt decides where a
    row is joined, never what with.
    """
    salt, mark = free_name(left, "salt"), free_name(left, "hot")
    named = hot.select(F.col(key).alias(mark))
    dealt = left.join(F.broadcast(named), left[key] == F.col(mark), "left")
    dealt = dealt.withColumn(salt, F.when(F.col(mark).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop(mark)
    wide = right.join(F.broadcast(named), right[key] == F.col(mark), "left")
    wide = wide.withColumn(salt, F.explode(F.sequence(F.lit(0), F.when(F.col(mark).isNotNull(), F.lit(salts - 1)).otherwise(F.lit(0))))).drop(mark)
    return dealt.join(wide, [key, salt], how).drop(salt)


#: Row names up to this many are sent to all tasks (about 100 bytes each there).
DROPPED_BY_BROADCAST = 500_000


def without_rows(docs: DataFrame, rid: str, dropped: DataFrame) -> DataFrame:
    """docs without the rows named in dropped(rid): few names go to the texts, many meet them in a shuffle."""
    names = dropped.select(rid).distinct()
    if names.count() <= DROPPED_BY_BROADCAST:
        names = F.broadcast(names)
    return docs.join(names, rid, "left_anti")
