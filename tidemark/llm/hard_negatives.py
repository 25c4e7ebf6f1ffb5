"""Hard negatives by slot-decomposed selection: a stated set of anchors against all rows, in blocks.

Every component x becomes floor(256 * x) and a score is the integer inner product of two rows, so that nothing depends
on the order of additions. An anchor's positives are its best rows of the same label. Each positive asks for the best
rows of other labels inside a window of scores that hangs on the positive's own score. The windows of one anchor
overlap; their upper limits cut the scores into disjoint slots, and every task keeps the best `k` rows of each slot and
nothing else. From the lowest slot upwards, the best `k` of a slot and of all below it are the slot's own rows followed by
those of the suffix below, cut at `k`: so one descending pass answers all windows, whose lower limits are applied last.

Rows are dealt into groups of GROUP by the hash of their id, and every group meets the anchors as a stream of blocks:
a task holds one group and one block of scores, whatever the size of the table. Neither anchors nor rows pass
through the driver. What a group returns is `k` rows for each slot of an anchor.

Defined results: rows with a null id, a null label, a null vector, or any null or non-finite component take no part; of
rows that share an id one takes part, the smallest by (label, vector), so repeated rows count once; equal scores are
ordered by the smaller id; vectors of other lengths than the anchor's have no score with it; a positive whose window holds
no row (a negative score's always) returns nothing, as does an anchor without positives; an empty table gives an empty
result; other columns are not read. Integers that could leave 64 bits are an error, not a wrong score.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SCALE = 256
#: Rows of a group and anchors of a block: a task holds GROUP vectors and BLOCK * GROUP scores.
GROUP, BLOCK = 8192, 256
col = F.col


def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Column | None = None) -> DataFrame:
    """(id, label, q): one row for each id, components as whole numbers; rows that take no part are gone."""
    x = col(vector)
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = rows.where(col(key).isNotNull() & col(label).isNotNull() & x.isNotNull() & ~F.coalesce(broken, F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(F.lit(SCALE) * v.cast("double")).cast("bigint"))
    named = kept.select(col(key).cast("bigint").alias("id"), F.struct((col(label) if relabel is None else relabel).cast("bigint").alias("label"), whole.alias("q")).alias("row"))
    return named.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.q", F.size("row.q").alias("dim"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums stay below 2**53, else by whole numbers."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = int(np.abs(anchors).max()) * int(np.abs(rows).max()) * anchors.shape[1]
    if most < 2**53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("vector components are too large for 64-bit scores")
    return anchors @ rows.T


def _best(at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The k places of `at` with the highest scores; rows lie in order of their ids, so a stable sort breaks ties."""
    s = score[at]
    if len(at) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = at[s >= least]
        s = score[at]
    return at[np.argsort(-s, kind="stable")[:k]]


def _task(pick, k: int):
    """Rows come sorted by (dim, g, kind, id): a group's rows first, then the anchors that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, ids, labels, rows = None, [], None, None, None
        for batch in batches:
            dim, g, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1
            edge = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:]):
                if a == b:
                    continue
                if (own := (int(dim[a]), int(g[a]))) != name:
                    name, held, rows = own, [], None
                part = batch.slice(a, b - a)
                if not kind[a]:
                    held.append(part)
                    continue
                if rows is None and held:
                    ids, labels = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held]) for c in (3, 4))
                    rows = np.concatenate([_matrix(p.column(5), name[0]) for p in held])
                if rows is None:
                    continue
                for s in range(0, part.num_rows, BLOCK):
                    block = part.slice(s, BLOCK)
                    score = _scores(_matrix(block.column(5), name[0]), rows)
                    out = [[], [], [], []]
                    own_id, own_label, limits = block.column(3).to_pylist(), block.column(4).to_pylist(), block.column(6).to_pylist()
                    for i in range(block.num_rows):
                        for slot, at in pick(score[i], ids, labels, own_id[i], own_label[i], limits[i], k):
                            out[0] += [own_id[i]] * len(at)
                            out[1] += [slot] * len(at)
                            out[2] += score[i][at].tolist()
                            out[3] += ids[at].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["anchor", "slot", "score", "id"])

    return run


def _same_label(score, ids, labels, own_id, own_label, limits, k):
    yield 0, _best(np.flatnonzero((labels == own_label) & (ids != own_id)), score, k)


def _by_slot(score, ids, labels, own_id, own_label, limits, k):
    """limits: upper limits in descending order, then the least score that any window admits."""
    *upper, least = limits
    rest = np.flatnonzero((labels != own_label) & (score <= upper[0]) & (score >= least))
    slot = len(upper) - 1 - np.searchsorted(np.array(upper[::-1]), score[rest], side="left")
    # A score belongs to the lowest limit that still covers it.
    for j in np.unique(slot).tolist():
        yield j, _best(rest[slot == j], score, k)


def _against(rows: DataFrame, anchors: DataFrame, groups: int, pick, k: int) -> DataFrame:
    """(anchor, slot, score, id, rank): the best k of each slot of every anchor, over all rows."""
    dealt = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), F.lit(0).alias("kind"), "id", "label", "q", F.lit(None).cast("array<bigint>").alias("limits"))
    asked = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.lit(1).alias("kind"), "id", "label", "q", "limits")
    both = dealt.unionByName(asked).repartition(groups, "dim", "g").sortWithinPartitions("dim", "g", "kind", "id")
    found = both.mapInArrow(_task(pick, k), "anchor long, slot int, score long, id long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """rows(id, label, q, dim) of `quantised` -> the first k negatives of every (anchor, positive).

    A negative's score, times 100, lies between low and high times the positive's, both included; is_anchor is a
    condition on id.
    """
    rows = common.stored(rows)
    groups = max(1, -(-rows.count() // GROUP))
    anchors = rows.where(is_anchor)
    best = _against(rows, anchors.withColumn("limits", F.lit(None).cast("array<bigint>")), groups, _same_label, positives)
    best = common.stored(best.select("anchor", col("id").alias("positive_id"), col("score").alias("positive_score")))
    upper = F.expr(f"cast(floor(cast(positive_score as decimal(20,0)) * {high} / 100) as bigint)")
    least = F.expr(f"cast(ceil(cast(positive_score as decimal(20,0)) * {low} / 100) as bigint)")
    # Windows that hold nothing have no slot.
    bounded = best.withColumns({"upper": upper, "least": least}).where("least <= upper")
    windows = bounded.groupBy("anchor").agg(F.reverse(F.array_sort(F.collect_set("upper"))).alias("uppers"), F.min("least").alias("low"))
    limits = F.concat("uppers", F.array("low")).alias("limits")
    slotted = anchors.join(windows.select(col("anchor").alias("id"), limits), "id")
    top = _against(rows, slotted, groups, _by_slot, k)
    # At most k rows for each of an anchor's slots, of which there are no more than positives.
    by_slot = top.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("kept"))
    asked = bounded.join(windows, "anchor").withColumn("slot", (F.array_position("uppers", col("upper")) - 1).cast("int"))
    suffixes = F.aggregate(
        F.sequence(F.size("uppers") - 1, F.lit(0), F.lit(-1)),
        F.expr("cast(array() as array<array<struct<slot:int,rank:int,id:bigint,score:bigint>>>)"),
        lambda acc, s: F.concat(F.array(F.slice(F.concat(F.filter("kept", lambda x: x["slot"] == s), F.coalesce(F.try_element_at(acc, F.lit(1)), F.expr("cast(array() as array<struct<slot:int,rank:int,id:bigint,score:bigint>>)"))), 1, k)), acc),
    )
    merged = by_slot.join(windows.select("anchor", "uppers"), "anchor").select("anchor", suffixes.alias("suffix"))
    inside = asked.join(merged, "anchor").select(
        "anchor", "positive_id", "positive_score", F.posexplode(F.filter(F.element_at("suffix", col("slot") + 1), lambda x: x["score"] >= col("least"))).alias("at", "row")
    )
    return inside.select(
        col("anchor").alias("anchor_id"), "positive_id", (col("at") + 1).cast("int").alias("rank"), col("row.id").alias("negative_id"), "positive_score", col("row.score").alias("negative_score")
    )
