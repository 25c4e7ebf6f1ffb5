"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring has CELLS equal cells. Every shard owns `vnodes` tokens on it; a row belongs to the first token
clockwise of the cell its key hashes to. Every shard has a quota, and quotas differ by one at most (law
`rows`): a row that arrives at a full shard continues clockwise to the next shard that has room.

Rows of one arc all follow the same clockwise path, so it is enough to place counts. Rows are ordered by
(arc, lane, place on the ring), where the lane, a second hash of the key, says who comes first when a shard
fills up; the counts of (arc, lane) pairs, at most shards * vnodes * lanes of them whatever the corpus size, are
placed in order on the driver, and each row finds its shard and slot by its rank in its (arc, lane). The order
is a range partitioning, so equal keys, however many, are dealt over as many tasks as they fill, and a rank is
the row's offset in its partition plus the count of the pair in the partitions before.

Where a row goes depends on the rows alone, not on files or partitions. Quotas without slack have a price in
movement, measured on 100,000 keys, 24 shards: 4 % of the rows are not at the first shard of their path; with
1 % of the rows gone, about 0.15 % of the others move; with a 25th shard 5.5 % move, 4 % of them into it and
1.5 % between old shards.

Defined results: null keys are placed by a hash of size and checksum; null text has size 8 and checksum 0;
rows that share key, size and checksum are placed separately, and which of them gets which of their places can't
be told from the result; very long texts count whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 14
_PART = 33  # monotonically_increasing_id: the partition lies above this bit


def tokens(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every token in ring order; of tokens in one cell the smallest shard's stays."""
    made = spark.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("token"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(CELLS)).cast("int").alias("cell"),
    )
    at: dict[int, int] = {}
    for row in sorted(made.collect()):
        at.setdefault(row["cell"], row["shard"])
    return [(cell, at[cell]) for cell in sorted(at)]


def place(counts: dict[tuple[int, int], int], owners: list[int], shards: int) -> list[tuple]:
    """(arc, lane, first, last, shard, slot) fragments: ranks first..last of a lane go to slots from slot.

    Lanes arrive one after the other, within a lane the arcs in ring order. At most one fragment for each
    count and one more for each shard that fills.
    """
    total = sum(counts.values())
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    path: dict[int, list[int]] = {}
    out = []
    for lane, arc in sorted((lane, arc) for arc, lane in counts):
        left, rank = counts[arc, lane], 1
        if arc not in path:
            path[arc] = list(dict.fromkeys([*owners[arc:], *owners[:arc], *range(shards)]))
        for shard in path[arc]:
            take = min(left, quota[shard] - filled[shard])
            if take:
                out.append((arc, lane, rank, rank + take - 1, shard, filled[shard]))
                filled[shard] += take
                rank, left = rank + take, left - take
            if not left:
                break
    return out


def assign(docs: DataFrame, shards: int = 24, vnodes: int = 128, lanes: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of docs."""
    spark = docs.sparkSession
    ring = tokens(spark, shards, vnodes)
    cells, arc = [], 0
    for cell in range(CELLS):
        while arc < len(ring) and ring[arc][0] < cell:
            arc += 1
        cells.append(arc % len(ring))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    known = F.col("key").isNotNull()
    hashed = lambda what: F.when(known, F.xxhash64(F.lit(what), F.col("key").cast("string"))).otherwise(F.xxhash64(F.lit(what), "size", "text_crc32"))
    lookup = F.from_json(F.lit(str(cells)), "array<int>")
    narrow = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row")
    ).withColumn("at", hashed("place"))
    # Kept once: the range partitioning samples its input, which would read the texts twice.
    narrow = common.cut(
        narrow.withColumns(
            {"arc": F.element_at(lookup, F.pmod("at", F.lit(CELLS)).cast("int") + 1), "lane": F.pmod(hashed("lane"), F.lit(lanes)).cast("int")}
        )
    )
    # `row` comes last: it lets the range partitioning split rows that are otherwise equal.
    order = ["arc", "lane", "at", "key", "size", "text_crc32", "row"]
    ordered = common.cut(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("row", "at").withColumn("__n", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__n", _PART))
    parts = ordered.groupBy("arc", "lane", "__part").agg(F.count("*").alias("n"), F.min("__n").alias("first")).collect()
    counts: dict[tuple[int, int], int] = {}
    before = []
    for r in sorted(parts):
        done = counts.get((r["arc"], r["lane"]), 0)
        before.append((r["arc"], r["lane"], r["__part"], r["first"] - done - 1))
        counts[r["arc"], r["lane"]] = done + r["n"]
    # Both tables have a bound: (arc, lane) pairs, and one more row for each partition or each full shard.
    starts = spark.createDataFrame(before, "arc int, lane int, __part long, __before long")
    plan = spark.createDataFrame(place(counts, [s for _, s in ring], shards), "arc int, lane int, first long, last long, shard int, slot0 long")
    return (
        ordered.join(F.broadcast(starts), ["arc", "lane", "__part"])
        .withColumn("rank", F.col("__n") - F.col("__before"))
        .join(F.broadcast(plan), ["arc", "lane"])
        .where(F.col("rank").between(F.col("first"), F.col("last")))
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
    )
