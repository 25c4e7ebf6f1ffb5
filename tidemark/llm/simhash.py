"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: A-Z lower-cased, words, 4-word shingles with repeats, XXH64 with seed 42 of each; a bit is 1
if it is set in over half of them. Links: at most `radius` differing bits.

Only distinct fingerprints are compared. The 64 bits are cut into `blocks` blocks; two fingerprints at
distance `radius` or less agree on at least blocks - radius of them, so each choice of that many blocks
is one table, and every link falls into some bucket of equal chosen blocks. The number of blocks follows from the
count of fingerprints (5 up to some 7 million, 8 at 10^11), so that buckets stay small. Spark deals the buckets out;
within a task each bucket is a Gray-order hierarchical index: fingerprints sorted by Gray rank, runs of
LEAF neighbours as leaves, runs of leaves as upper nodes, each node holding the bit pattern its members
share and the mask of where they share it. Two nodes whose shared patterns already differ in more than
`radius` commonly masked bits are left out with all their members; what remains is compared exactly.
A bucket of over SPLIT rows is dealt evenly into cells whose pairs are separate buckets, so a hot bucket
is no single task. A task returns a spanning forest of each bucket's links, not all its pairs. Fingerprints, nodes
and components that a large share of the rows hold are dealt over many tasks where rows meet their group.

Defined results: no words (null, empty, blank): fingerprint zero, linked like any other; fewer than four
words: the whole sequence is the one shingle; a null id takes part in links, and a component without any
id has a null component id; repeated rows each get a result; very long texts are read whole; an empty table gives an
empty result; other columns are not read, and pass through `keep_one` whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

BITS, WIDTH, SEED = 64, 4, 42
LEAF, FAN, SPLIT = 32, 16, 2048
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > WIDTH:
        starts, ends = starts[: len(parts) - WIDTH + 1], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > len(h)).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed long; the key may be a struct."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_fingerprints, f"key {kind}, fp long")


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose buckets hold SPLIT / 2 fingerprints or fewer on average, of n fingerprints.

    Fewer blocks are fewer tables (C(blocks, radius)) with fuller buckets; no choice loses a link.
    """
    blocks = radius + 1
    while n / 2 ** (BITS * (blocks - radius) / blocks) > SPLIT / 2 and blocks < 2 * radius:
        blocks += 1
    return blocks


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Rank of each pattern in Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _nodes(fp: np.ndarray, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run of `fan` fingerprints: the shared pattern and the mask of the bits all members share."""
    at = np.arange(0, len(fp), fan)
    ones, some = np.bitwise_and.reduceat(fp, at), np.bitwise_or.reduceat(fp, at)
    return ones, ~(ones ^ some)


def links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with a[i] and b[j] at most `radius` bits apart; a and b in Gray order.

    Two levels: upper nodes over FAN leaves each, then leaves, then members, each level only below
    node pairs whose shared masked bits differ in `radius` bits or fewer.
    """
    found_i, found_j = [], []
    upper_a, upper_b = _nodes(a, LEAF * FAN), _nodes(b, LEAF * FAN)
    leaf_a, leaf_b = _nodes(a, LEAF), _nodes(b, LEAF)

    def survivors(x, y):
        return np.nonzero(np.bitwise_count((x[0][:, None] ^ y[0][None, :]) & x[1][:, None] & y[1][None, :]) <= radius)

    for i, j in zip(*survivors(upper_a, upper_b)):
        cut_a, cut_b = slice(i * FAN, (i + 1) * FAN), slice(j * FAN, (j + 1) * FAN)
        for p, q in zip(*survivors((leaf_a[0][cut_a], leaf_a[1][cut_a]), (leaf_b[0][cut_b], leaf_b[1][cut_b]))):
            s, t = (i * FAN + p) * LEAF, (j * FAN + q) * LEAF
            u, v = np.nonzero(np.bitwise_count(a[s : s + LEAF, None] ^ b[None, t : t + LEAF]) <= radius)
            found_i.append(u + s)
            found_j.append(v + t)
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


class Forest:
    """Union-find over the members of one bucket."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def bucket_edges(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one bucket, or of those between two stretches of it."""
    a = left[np.argsort(gray_rank(left))]
    b = a if right is None else right[np.argsort(gray_rank(right))]
    i, j = links(a, b, radius)
    if right is None:
        up = i < j
        i, j = i[up], j[up]
    shift = 0 if right is None else len(a)
    forest, out = Forest(len(a) + (0 if right is None else len(b))), []
    for x, y in zip(i.tolist(), j.tolist()):
        if forest.join(x, y + shift):
            out.append((int(a[x].view(np.int64)), int(b[y].view(np.int64))))
    return out


def _bucket_task(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, cell_a, cell_b); a bucket may span batches."""
        held: list[np.ndarray] = []
        name = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            fp, side = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            if len(fp) < 2:
                return
            first, second = fp[side == 0], fp[side == 1]
            if name[1] == name[2]:
                out.extend(bucket_edges(first, None, radius))
            elif len(first) and len(second):
                out.extend(bucket_edges(first, second, radius))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            fp, side = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(5).to_numpy(zero_copy_only=False)
            new = np.ones(len(fp), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            at = [*np.flatnonzero(new).tolist(), len(fp)]
            for s, t in zip(at, at[1:]):
                own = (int(cols[0][s]) << 64 | (int(cols[1][s]) & (1 << 64) - 1), int(cols[2][s]), int(cols[3][s]))
                if own != name and name is not None:
                    close()
                    held = []
                name = own
                held.append((fp[s:t], side[s:t]))
            if len(out) >= 20000:
                yield batch_of(out)
                out.clear()
        if name is not None:
            close()
        if out:
            yield batch_of(out)

    return run


def _tables(blocks: int, radius: int) -> list[int]:
    """The masks of the chosen blocks, one for each table."""
    edge = [round(k * BITS / blocks) for k in range(blocks + 1)]
    one = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    return [sum(one[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def near_pairs(distinct: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """distinct(fp) without repeats -> (a, b): edges at distance `radius` or less that connect all linked fps."""
    blocks = blocks_for(distinct.count(), radius) if blocks is None else blocks
    masks = [m - (1 << 64) if m >> 63 else m for m in _tables(blocks, radius)]
    rows = distinct.select(
        "fp", F.posexplode(F.array(*[F.lit(m).cast("bigint").bitwiseAND(F.col("fp")) for m in masks])).alias("table", "bucket")
    )
    # Buckets that hold one fingerprint need no task; large ones are cut into cells, joined pair by pair.
    size = rows.groupBy("table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    cells = F.when(F.col("n") <= SPLIT, 1).otherwise(F.ceil(F.col("n") / SPLIT)).cast("int")
    rows = rows.join(size, ["table", "bucket"]).withColumn("cells", cells)
    cell = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    sides = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda k: F.struct(F.least(k, F.col("cell")).alias("x"), F.greatest(k, F.col("cell")).alias("y"), (k < F.col("cell")).cast("int").alias("side")),
    )
    dealt = rows.withColumn("cell", cell).select("table", "bucket", "fp", F.explode(sides).alias("s")).select(
        F.col("table").cast("long").alias("table"), "bucket", F.col("s.x").cast("long").alias("x"), F.col("s.y").cast("long").alias("y"), "fp", "s.side"
    )
    keys = ["table", "bucket", "x", "y"]
    sorted_rows = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(_bucket_task(radius), "a long, b long").distinct()


def _grouped(marked: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, least) for the fingerprints of marked(key, fp), least being the smallest key of the component, and the hot fps."""
    distinct = common.cut(marked.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    roots = components.connected(near_pairs(distinct.select("fp"), radius))
    labelled = common.cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = common.cut(labelled.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")))
    by_fp = common.salted_join(labelled.drop("least"), named.drop("n"), "root", common.hot_keys(named, "root"), "inner")
    return by_fp.select("fp", "least"), common.hot_keys(distinct, "fp")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row of docs."""
    marked = common.cut(fingerprints(docs, key, text))
    by_fp, hot = _grouped(marked, radius)
    return common.salted_join(marked, by_fp, "fp", hot).select(F.col("key").alias(key), "fp", F.col("least").alias("component_id"))


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """Exactly one row of docs for each group: that of the smallest key, a null key last.

    Rows are told apart by their place in their file, so repeated rows, shared keys and null keys are rows like any
    other; among rows of one key the text with the smallest hash stays, then the first in the files.
    """
    rows, rid = common.with_row_id(docs)
    order = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.xxhash64(text).alias("text"), F.col(rid).alias("rid"))
    marked = common.cut(fingerprints(rows.select(order.alias("place"), text), "place", text))
    by_fp, hot = _grouped(marked, radius)
    dropped = common.salted_join(marked, by_fp, "fp", hot).where(F.col("key.rid") != F.col("least.rid")).select(F.col("key.rid").alias(rid))
    return common.without_rows(rows, rid, common.cut(dropped)).select(*docs.columns)
