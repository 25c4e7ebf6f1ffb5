"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    """Three figures of an edge table that any change of its rows changes (but for a chance of 2**-64)."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def _smallest(edges: DataFrame, path: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(u, smallest v) and the hot u: both from one aggregate, partial in the tasks that read the edges."""
    found = common.stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), path)
    return found, common.hot_keys(found, "u", total=total)


def connected(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges(a, b) of one orderable type -> (node, root): root is the smallest node reachable.

    Each step links every node's neighbours to the smallest node it sees; both steps are an aggregate and
    a join, in which a node of many neighbours is dealt over many tasks, and the table is written after each round.
    The rounds needed grow with the square of the logarithm of the nodes at most; not to be done after `rounds` of
    them is an error. Nodes without an edge are absent; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    folder = f"{common.shared_dir(spark)}/components-{uuid.uuid4().hex}"
    now = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/0/edges")
    state, k = _state(now), 0
    while state[0]:
        if k == rounds:
            raise RuntimeError(f"components are not complete after {rounds} rounds")
        k, here = k + 1, f"{folder}/{k + 1}"
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, hot = _smallest(both, f"{here}/large", 2 * state[0])
        least = least.select("u", F.least("u", "m").alias("m"))
        large = common.salted_join(both, least, "u", hot, "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.where("u <> v").distinct(), f"{here}/links")
        least, hot = _smallest(large, f"{here}/small", state[0])
        least = least.select("u", "m")
        star = common.salted_join(large, least, "u", hot, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.stored(star.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"{here}/edges")
        common.discard(spark, f"{folder}/{k - 1}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))
