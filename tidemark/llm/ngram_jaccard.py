"""Exact n-gram Jaccard self-join by a size-aware split into light and heavy sets, down to connected components.

A document's set holds its distinct 3-word shingles as 64-bit hashes. Documents of equal sets are one class, and only
classes are compared. Two sets link when percent / 100 of their union is shared; sizes a and b then need
need(a, b) = ceil(percent * (a + b) / (100 + percent)) common elements.

* Light sets, of `boundary` elements or fewer, enumerate their subsets of every size c = need(n, m) that a partner
  may ask for; two light sets link only if they have such a subset in common.
* Heavy sets scan inverted lists. In one order of all shingles, rare ones first, two sets that link share an element of their
  first n - ceil(percent * n / 100) + 1 ones, so lists hold those alone; light sets close to the boundary are in them too.
  How rare a shingle is, is counted exactly for a fixed SLICE of all hashes; a set with enough elements of the slice that
  no other set has fills its first ones with them, links with nothing and is done. Most sets are.
* The boundary follows from the cost of both: subsets to be made against lengths of the lists to be read, size by size.

Both ways give keys, and rows of one key are a bucket. In a bucket, pairs are
held against lossless bounds: sizes, places of the key in both orders, and parity sketches (each element flips one bit, so
that sketches differ in no more bits than sets in elements). What survives is verified on whole sets, in two rounds,
so that a family of n near copies costs some n verifications and not n squared:

1 of each bucket, a minimum spanning forest of the surviving pairs, nearest sketches first;
2 of buckets that still hold several components, every surviving pair between components that was not tested.

A link left out in both rounds joins two sets that are connected already. Hot keys are known from counts over the whole corpus
(HOT of them, which decide the order of shingles and how rows are dealt, never which links are found) and are dealt over
many tasks; in round 2 a large bucket becomes cells of two stretches each.

Equality of shingles is equality of 64-bit hashes (`word_hashes`): for a pair of sets of n elements the chance of any error is some n * n / 2**64.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component; fewer
words than three are one element; very long texts are read whole; repeated rows are one class and get a result each; a
null id takes part in links, and a component without any id has a null component id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, word_hashes

WIDTH, PERCENT = 3, 90
#: Shingles known as frequent; the least documents of a block that make one so; elements counted in one go.
HOT, HOT_DOCS, HELD = 400_000, 4, 2_000_000
#: Hashes below this one are counted exactly: a quarter.
SLICE = np.uint64(1 << 62)
#: Sets up to this size are kept whole, so that the boundary can be put anywhere below.
SMALL = 40
#: Rows of a bucket that are compared with each other in round 1, and of a stretch in round 2.
CHUNK = 1024
SKETCH_BITS = (256, 2048)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
col = F.col


def _poly() -> word_hashes.Polynomial:
    return word_hashes.Polynomial(12, lower=True)


def shingles(h: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of a text's set, from the hashes of its words."""
    if not len(h):
        return h
    width = min(WIDTH, len(h))
    x = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        x += h[k : len(h) - width + 1 + k] * _ODD[k]
    x = np.sort(word_hashes.mixed(x))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """The fewest common elements of two linked sets of a and b elements."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    """The sizes of subsets that a set of n elements may have to share with a partner of any admissible size."""
    return sorted({need(n, m, percent) for m in range(-(-percent * n // 100), 100 * n // percent + 1)})


def boundary_of(sizes: dict[int, tuple[int, float]], percent: int = PERCENT) -> int:
    """The size up to which enumerating is cheaper than scanning; sizes: n -> (sets, lengths of the lists they would read)."""
    def cost(b: int) -> float:
        total = 0.0
        for n, (sets, lists) in sizes.items():
            total += sets * sum(comb(n, c) for c in subset_sizes(n, percent)) if n <= b else 0
            total += lists if n > b or percent * (b + 1) <= 100 * n else 0
        return total

    return min(range(SMALL + 1), key=lambda b: (cost(b), b))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): shingles in at least HOT_DOCS documents of a block of HELD elements."""
    poly, held, size = _poly(), [], 0

    def found() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= HOT_DOCS
        return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    for batch in batches:
        for words in word_hashes.by_text(batch.column(0), poly):
            held.append(shingles(words))
            size += len(held[-1])
            if size >= HELD:
                yield found()
                held, size = [], 0
    if held:
        yield found()


class Order:
    """What is known of frequent shingles."""

    def __init__(self, h: np.ndarray, n: np.ndarray):
        at = np.argsort(h)
        self.h, self.n = h[at], n[at]

    def lengths(self, x: np.ndarray) -> np.ndarray:
        """About how many documents hold each; 0 where not known as frequent."""
        if not len(self.h):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.h, x), len(self.h) - 1)
        return np.where(self.h[at] == x, self.n[at], 0)


def frequent(docs: DataFrame, text: str = "text") -> Order:
    """The HOT most frequent shingles of the corpus with their counts: a table of that bound for every task."""
    rows = docs.select(text).mapInArrow(_frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HOT).toPandas()
    return Order(rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64))


def _binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    poly = _poly()
    for batch in batches:
        found = [shingles(words) for words in word_hashes.by_text(batch.column(2), poly)]
        names = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int32()), pa.array(names, pa.binary())], names=["rid", "key", "n", "name"])


def _in_slice(x: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Elements whose sets are counted; those of frequent keys are known to be shared."""
    return (x < SLICE) & (often <= CHUNK)


def _sliced(order, percent: int):
    """(h, id, spare): a set's elements of the slice; it is done if no more than `spare` of them are shared.

    Sets that have too few elements there whatever is shared come as (null, id, spare).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = _poly()
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                h, ids, spare, sure = [], [], [], []
                for name, words in zip(part.column(0).to_pylist(), word_hashes.by_text(part.column(1), poly)):
                    x = shingles(words)
                    k = prefix(len(x), percent)
                    x = x[_in_slice(x, order.value.lengths(x))]
                    if len(x) < k:
                        sure.append(name)
                    h.append(x)
                    ids.append(np.full(len(x), name, np.int64))
                    spare.append(np.full(len(x), len(x) - k, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ([x.view(np.int64) for x in h], ids, spare)], names=["h", "id", "spare"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(sure), pa.int64()), pa.array(sure, pa.int64()), pa.array([-1] * len(sure), pa.int32())], names=["h", "id", "spare"])

    return run


#: Rows of one key that a task holds to count them; a key of more counts as WAITING.
WAITING = 20_000


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h: (id, h, n, spare) of those whose h several sets have, n of them."""

    def counted(h, ids, spare, known=None) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.repeat(np.diff(np.append(new, len(h))), np.diff(np.append(new, len(h)))) if known is None else np.full(len(h), known)
        kept = n > 1
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (ids, h, n.astype(np.int32), spare.astype(np.int32))], names=["id", "h", "n", "spare"])

    held, going = None, None
    for batch in batches:
        # Rows without a hash come first and pass through.
        alone = batch.column(0).null_count
        if alone:
            yield pa.RecordBatch.from_arrays([batch.column(1)[:alone], batch.column(0)[:alone], pa.nulls(alone, pa.int32()), batch.column(2)[:alone]], names=["id", "h", "n", "spare"])
        batch = batch.slice(alone)
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if going is not None:
            k = int(np.argmin(cols[0] == going)) if (cols[0] != going).any() else len(cols[0])
            if k:
                yield counted(*(c[:k] for c in cols), known=WAITING)
            cols = [c[k:] for c in cols]
            if not len(cols[0]):
                continue
            going = None
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        last = int(np.argmax(cols[0] == cols[0][-1]))
        if last:
            yield counted(*(c[:last] for c in cols))
        held = [c[last:] for c in cols]
        if len(held[0]) >= WAITING:
            yield counted(*held, known=WAITING)
            held, going = None, held[0][0]
    if held is not None:
        yield counted(*held)


def _ordered(order, percent: int):
    """A set's first elements, rare ones first (the whole set if small), which of them others may have, and how long their lists are.

    Elements of the slice weigh as many as sets have them, others by the table of frequent ones, 2 at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [], [], [], []
            for elements, live in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(elements, np.uint64)
                often = order.value.lengths(x)
                weight = np.where(_in_slice(x, often), 1, np.maximum(often, 2))
                if live:
                    weight[np.searchsorted(x, np.array([r["h"] for r in live], np.int64).view(np.uint64))] = [r["n"] for r in live]
                at = np.lexsort((x, weight))
                k = prefix(len(x), percent)
                at = at if len(x) <= SMALL else at[:k]
                out[0].append(len(x))
                out[1].append(x[at])
                out[2].append((weight[at] > 1).astype(np.uint8))
                out[3].append(float(weight[at[:k]].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int32()), _binary(out[1]), _binary(out[2]), pa.array(out[3], pa.float64())], names=["id", "n", "items", "live", "lists"])

    return run


def _keys(boundary: int, percent: int):
    """A class's keys and their places: subsets (place -1) and the first elements of its order that others may have."""

    def of(n: int, items: bytes, live: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(items, np.uint64)
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        if n <= boundary:
            whole = x.sum(dtype=np.uint64)
            for c in subset_sizes(n, percent):
                gone = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
                h = word_hashes.mixed(whole - x[gone].sum(1, dtype=np.uint64) + np.uint64(c) * _ODD[0])
                found.append((h, np.full(len(h), -1, np.int32)))
        if n > boundary or percent * (boundary + 1) <= 100 * n:
            at = np.flatnonzero(np.frombuffer(live, np.uint8)[: prefix(n, percent)]).astype(np.int32)
            found.append((x[at], at))
        h, pos = (np.concatenate(p) for p in zip(*found))
        return h, pos

    return of


def _sketch(x: np.ndarray) -> np.ndarray:
    bits = min(max(1 << len(x).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    odd = np.bincount((x % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    poly = _poly()
    for batch in batches:
        found = [shingles(words) for words in word_hashes.by_text(batch.column(1), poly)]
        yield pa.RecordBatch.from_arrays([batch.column(0), _binary([_sketch(x) for x in found]), _binary(found)], names=["id", "sketch", "elements"])


def _exploded(boundary: int, percent: int, order):
    """(h, deal, id, n, pos, comp, sketch): the rows of the buckets; deal: over how many stretches a frequent key is dealt."""
    keys = _keys(boundary, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, items, live, comp, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                h, pos = keys(n, items, live)
                deal = np.maximum(1, -(-order.value.lengths(h) // CHUNK)).astype(np.int32)
                k = len(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(deal), pa.array(np.full(k, name, np.int64)), pa.array(np.full(k, n, np.int32)), pa.array(pos), pa.array(np.full(k, comp, np.int64)), pa.array([sketch] * k, pa.binary())],
                    names=["h", "deal", "id", "n", "pos", "comp", "sketch"])

    return run


def _distances(sketches: list[bytes], others: list[bytes]) -> np.ndarray:
    """Differing bits of all pairs; a longer sketch is folded to the length of the shorter one."""
    def by_length(rows):
        lengths = np.array([len(r) for r in rows])
        return [(w, at := np.flatnonzero(lengths == w), np.frombuffer(b"".join(rows[i] for i in at.tolist()), np.uint64).reshape(len(at), w // 8)) for w in np.unique(lengths).tolist()]

    def folded(x, words):
        while x.shape[1] > words:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        return x

    out = np.zeros((len(sketches), len(others)), np.int32)
    for w, i, a in by_length(sketches):
        for v, j, b in by_length(others):
            words = min(w, v) // 8
            x, y = folded(a, words), folded(b, words)
            for s in range(0, len(i), 64):
                out[np.ix_(i[s : s + 64], j)] = np.bitwise_count(x[s : s + 64, None] ^ y[None]).sum(-1, dtype=np.int32)
    return out


def _survivors(a: tuple, b: tuple, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(differing bits, which pairs the bounds leave open); a and b are (id, n, pos, comp, sketch) of two lists of rows."""
    n, m = a[1][:, None].astype(np.int64), b[1][None].astype(np.int64)
    common_least = -(-percent * (n + m) // (100 + percent))
    left = np.minimum(n - a[2][:, None], m - b[2][None])
    light = (n <= boundary) & (m <= boundary)
    subset = (a[2] < 0)[:, None] & (b[2] < 0)[None]
    listed = (a[2] >= 0)[:, None] & (b[2] >= 0)[None] & ~light
    open_ = (a[3][:, None] != b[3][None]) & (percent * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (subset | (listed & (left >= common_least)))
    if not open_.any():
        return np.zeros(open_.shape, np.int32), open_
    bits = _distances(a[4], b[4])
    return bits, open_ & (bits <= n + m - 2 * common_least)


def _forest(bits: np.ndarray, open_: np.ndarray) -> list[tuple[int, int]]:
    """A minimum spanning forest of the open pairs of one list of rows."""
    far = np.iinfo(np.int32).max
    weight = np.where(open_, bits, far)
    best, come, out = np.full(len(bits), far, np.int64), np.zeros(len(bits), np.int64), np.zeros(len(bits), bool)
    edges = []
    for _ in range(len(bits)):
        at = int(np.argmin(np.where(out, np.int64(far) + 1, best)))
        if best[at] < far:
            edges.append((int(come[at]), at))
        out[at] = True
        nearer = weight[at] < best
        best[nearer], come[nearer] = weight[at][nearer], at
    return edges


def _cells(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Stretches of equal leading columns, of rows that come sorted by them; of `most` rows at most, if given."""
    name, held, size = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        edge = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for s, t in zip(edge, edge[1:]):
            own = tuple(int(c[s]) for c in cols)
            if own != name:
                if held:
                    yield name, held
                name, held, size = own, [], 0
            while s < t:
                e = t if most is None else min(t, s + most - size)
                held.append(batch.slice(s, e - s))
                size, s = size + e - s, e
                if size == most:
                    yield name, held
                    held, size = [], 0
    if held:
        yield name, held


def _members(held: list[pa.RecordBatch], first: int) -> tuple:
    """(id, n, pos, comp, sketch) from the columns that begin with `first`."""
    cols = [np.concatenate([b.column(first + k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4)]
    return (*cols, [s for b in held for s in b.column(first + 4).to_pylist()])


def _pairs(a: list[int], b: list[int], kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def _first_round(boundary: int, percent: int):
    """Rows sorted by (h, x): forest edges (kind 0), and h (kind 1) where more than a forest could be needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, marked, last = [], [], [], None
        for name, held in _cells(batches, 2, CHUNK):
            rows = _members(held, 3)
            split = name == last or held[0].column(2)[0].as_py() > 1
            last = name
            found = []
            if len(rows[0]) > 1:
                bits, open_ = _survivors(rows, rows, boundary, percent)
                np.fill_diagonal(open_, False)
                found = _forest(bits, open_) if open_.any() else []
            for i, j in found:
                x, y = int(rows[0][i]), int(rows[0][j])
                a.append(min(x, y))
                b.append(max(x, y))
            if split or len(found) > 0 and len(rows[0]) > 2:
                marked.append(name[0])
            if len(a) + len(marked) > 20_000:
                yield _pairs(a, b, 0)
                yield _pairs(marked, marked, 1)
                a, b, marked = [], [], []
        yield _pairs(a, b, 0)
        yield _pairs(marked, marked, 1)

    return run


def _second_round(boundary: int, percent: int):
    """Rows sorted by (h, x, y, side): every open pair of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, held in _cells(batches, 3):
            side = np.concatenate([h.column(3).to_numpy(zero_copy_only=False) for h in held])
            rows = _members(held, 4)
            part = lambda k: (*(c[side == k] for c in rows[:4]), [s for s, v in zip(rows[4], side.tolist()) if v == k])
            left, right = part(0), part(0) if name[1] == name[2] else part(1)
            for s in range(0, len(left[0]), 128):
                few = tuple(c[s : s + 128] for c in left)
                i, j = np.nonzero(_survivors(few, right, boundary, percent)[1])
                x, y = few[0][i], right[0][j]
                yield _pairs(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), 0)

    return run


def _checked(percent: int):
    """Rows sorted by (a, salt, lead): the set of a, then those of its partners; links are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for batch in batches:
            out = [], []
            for a, salt, lead, b, elements in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(elements, np.uint64)
                if not lead:
                    own, mine = (a, salt), x
                    continue
                assert own == (a, salt)
                both = len(np.intersect1d(mine, x, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(x) - both):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return run


#: Rows of (number, number) up to this many go to the wide rows by broadcast.
SENT = 500_000


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SENT else rows


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The linked ones of pairs(a, b) by their whole sets(id, elements); a set moves once for each pair, and once for each a."""
    pairs = common.stored(pairs)
    hot = common.hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    salt = F.when(col("hot"), F.pmod(F.xxhash64("b"), F.lit(64))).otherwise(0).cast("int")
    dealt = pairs.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "a", "left").fillna(False, ["hot"]).select("a", salt.alias("salt"), "b")
    asked = dealt.select("a", "salt", F.lit(1).alias("lead"), col("b").alias("id")).unionByName(dealt.select("a", "salt", F.lit(0).alias("lead"), col("a").alias("id")).distinct())
    wide = sets.select("id", "elements").join(_sent(common.stored(asked)), "id").select("a", "salt", "lead", "id", "elements")
    return wide.repartition("a", "salt").sortWithinPartitions("a", "salt", "lead").mapInArrow(_checked(percent), "a long, b long")


def _labelled(edges: DataFrame) -> DataFrame:
    return components.connected(edges).select(col("node").alias("id"), col("root").alias("comp"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row of docs; the component's name is the smallest key in it."""
    spark: SparkSession = docs.sparkSession
    rows, rid = common.with_row_id(docs.select(key, text))
    order = spark.sparkContext.broadcast(frequent(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    given = rows.select(col(rid).alias("rid"), col(key).alias("key"), text)
    described = common.stored(given.mapInArrow(_described, f"rid string, key {kind}, n int, name binary"))
    named = described.where("n > 0").groupBy("name").agg(F.min("rid").alias("rid"), F.min("key").alias("least"), F.first("n").alias("n"), F.count("*").alias("rows"))
    classes = common.stored(named.withColumn("id", F.monotonically_increasing_id()))

    one_each = lambda of: rows.join(_sent(of.select("id", col("rid").alias(rid))), rid).select("id", text)
    sliced = one_each(classes).mapInArrow(_sliced(order, percent), "h long, id long, spare int")
    # Rows without a hash are dealt by their id and pass through.
    met = sliced.repartition(F.coalesce("h", F.xxhash64("id"))).sortWithinPartitions("h")
    shared = common.stored(met.mapInArrow(_shared, "id long, h long, n int, spare int"))
    few_alone = shared.groupBy("id").agg(F.count("h").alias("n"), F.min("spare").alias("spare")).where(col("n") > col("spare")).select("id")
    involved = common.stored(few_alone)
    sets = common.stored(one_each(classes.join(involved, "id")).mapInArrow(_sets, "id long, sketch binary, elements binary"))
    # No more of them than a set has elements.
    lists = shared.where("h is not null").join(_sent(involved), "id").groupBy("id").agg(F.collect_list(F.struct("h", "n")).alias("live"))
    ordered = common.stored(sets.join(lists, "id", "left").select("id", "elements", "live").mapInArrow(_ordered(order, percent), "id long, n int, items binary, live binary, lists double"))
    sizes = {r["n"]: (r["sets"], r["lists"]) for r in ordered.where(col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("sets"), F.sum("lists").alias("lists")).collect()}
    boundary = boundary_of(sizes, percent)
    members = common.stored(ordered.drop("lists").join(sets.select("id", "sketch"), "id"))

    shape = "h long, deal int, id long, n int, pos int, comp long, sketch binary"
    exploded = members.select("id", "n", "items", "live", col("id").alias("comp"), "sketch").mapInArrow(_exploded(boundary, percent, order), shape)
    dealt = exploded.select("h", F.pmod(F.xxhash64("id"), col("deal")).cast("int").alias("x"), "deal", "id", "n", "pos", "comp", "sketch").repartition("h", "x").sortWithinPartitions("h", "x", "n")
    first = common.stored(dealt.mapInArrow(_first_round(boundary, percent), "kind int, a long, b long").distinct())
    tested = first.where("kind = 0").select("a", "b")
    links = common.stored(verified(tested, sets, percent))
    comps = common.stored(_labelled(links))

    marked = first.where("kind = 1").select(col("a").alias("h"))
    now = members.join(comps, "id", "left").select("id", "n", "items", "live", F.coalesce("comp", "id").alias("comp"), F.lit(b"").alias("sketch"))
    place = now.mapInArrow(_exploded(boundary, percent, order), shape).drop("sketch", "deal").join(marked, "h", "left_semi")
    open_keys = place.groupBy("h").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h", "m")
    open_keys = common.stored(open_keys)
    if not open_keys.isEmpty():
        cells = F.ceil(col("m") / CHUNK).cast("int")
        sides = F.transform(F.sequence(F.lit(0), col("cells") - 1), lambda k: F.struct(F.least(k, col("x")).alias("x"), F.greatest(k, col("x")).alias("y"), (k < col("x")).cast("int").alias("side")))
        spread = place.join(open_keys, "h").withColumn("cells", cells).withColumn("x", F.pmod(F.xxhash64("id"), col("cells")).cast("int")).select("h", "id", "n", "pos", "comp", F.explode(sides).alias("c"))
        wide = spread.join(sets.select("id", "sketch"), "id").select("h", "c.x", "c.y", "c.side", "id", "n", "pos", "comp", "sketch")
        more = wide.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "side").mapInArrow(_second_round(boundary, percent), "kind int, a long, b long")
        more = more.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        added = common.stored(verified(more, sets, percent))
        if not added.isEmpty():
            # Components of components: what is linked already counts as one node.
            of = lambda c, name: comps.select(col("id").alias(c), col("comp").alias(name))
            between = added.join(of("a", "u"), "a", "left").join(of("b", "v"), "b", "left").select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b"))
            joined = common.stored(_labelled(between).select(col("id").alias("comp"), col("comp").alias("root")))
            everyone = comps.unionByName(joined.select(col("comp").alias("id"), "comp").join(comps, "id", "left_anti"))
            comps = common.stored(everyone.join(joined, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")))

    labelled = common.stored(classes.select("name", "id", "least", "rows").join(comps, "id", "left").select("name", "rows", "least", F.coalesce("comp", "id").alias("comp")))
    least = common.stored(labelled.groupBy("comp").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    by_name = common.salted_join(labelled, least.select("comp", "component_id"), "comp", common.hot_keys(least, "comp"), "inner").select("name", "component_id")
    hot = common.hot_keys(labelled.select("name", "rows"), "name", "rows")
    whole = common.salted_join(described.where("n > 0").select("key", "n", "name"), by_name, "name", hot, "inner").select("key", "n", "component_id")
    alone = described.where("n = 0").select("key", "n", col("key").alias("component_id"))
    return whole.unionByName(alone).select(col("key").alias(key), col("n").cast("long").alias("n_shingles"), "component_id")
