"""Removal of repeated 100-byte strings by prefix-free parsing.

A document is parsed at triggers: a trigger is the place of the least rolling hash among the KGRAM-byte
grams of some `length`-byte window (leftmost on ties), so every window holds a trigger of its own and
equal windows have equal triggers at equal places. A phrase is the text of all windows of one trigger: it
reaches `length` - 1 bytes past its last window's start, which is all of the following parse that can
matter to the order of suffixes to depth `length`.

The dictionary is the table of distinct phrases with the first place of each. Phrases whose trigger has
one phrase only are settled: windows of a first phrase are new, windows of its copies are repeats. For
triggers with several distinct phrases the dictionary's phrases, not the corpus, are opened into suffixes
(windows): with at most FEW phrases a trigger's suffixes are sorted to depth `length` in one task, a suffix
array in which equal neighbours give way to the first place (a phrase has at most `length` - KGRAM + 1 windows, so an
array has a bounded size, some 1 MB); with more they are dealt out by content and aggregated, so no task gathers
them. Copies, however many, cost a row for each stretch of text.

A trigger that many distinct phrases share (the edge of a passage that a large share of all documents hold) is known
beforehand from a hint, and its phrases are dealt over many tasks; FEW and the hint decide how suffixes are dealt to
tasks, never which are compared.

What is carried to documents is the list of *first* phrases and, for opened ones, which windows repeat (few)
or are first (many); everything else repeats. Equality of phrases and of dealt windows is that of 128 bits of hash
(trigger 64, content 64): among n of them the chance of one false match is about n^2 / 2^129, below 1e-12 for the
windows of 100 TB. The suffixes of few phrases are compared byte by byte.

Defined results: null text is empty; documents shorter than `length` bytes keep every byte; very long texts are parsed
whole (up to 2^31 bytes); rows that share an id are ordered by a hash of their text, and rows that share id and text
are one document; null ids come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LENGTH, KGRAM, FEW = 100, 28, 64
HINT, HOT_LEAST, HOT_SHARE, SALTS = 64, 16, 1000, 256
_P = 0x100000001B3
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(2 * n, 1 << 16)
        up, down = np.full(size, _P, np.uint64), np.full(size, pow(_P, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


class Parse:
    """The phrases of one document: trigger hash, first and last window start of each."""

    def __init__(self, raw: bytes, length: int = LENGTH):
        b = np.frombuffer(raw, np.uint8)
        n, kgram = len(b), min(KGRAM, length)
        self.length, self.windows = length, max(0, n - length + 1)
        self.trigger, self.first, self.last = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.windows:
            return
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=self.sums[1:])
        at = np.arange(n - kgram + 1)
        # The low bits hold the place, so that a minimum is unique and the leftmost wins.
        g = self.hashes(at, at + kgram) & ~np.uint64((1 << 32) - 1) | at.astype(np.uint64)
        width, span, low = length - kgram + 1, 1, g
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: self.windows], low[width - span : width - span + self.windows])
        self.first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        self.last = np.concatenate((self.first[1:] - 1, [self.windows - 1]))
        self.place = (low[self.first] & np.uint64((1 << 32) - 1)).astype(np.int64)
        # 32 bits choose the place; all 64 of the gram there name the trigger.
        self.trigger = self.hashes(self.place, self.place + kgram)

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def contents(self) -> np.ndarray:
        """Hash of each phrase's bytes and of its trigger's place in it."""
        if not self.windows:
            return np.zeros(0, np.uint64)
        h = self.hashes(self.first, self.last + self.length)
        return h ^ ((self.place - self.first).astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _phrases(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def made() -> pa.RecordBatch:
            """The distinct phrases of a stretch of text, each with its first place."""
            trigger, content, doc, first = (np.concatenate([h[k] for h in held]) for k in range(4))
            order = np.lexsort((first, doc, trigger, content))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (trigger[order][1:] != trigger[order][:-1])
            trigger, content, doc, first = (x[order[new]] for x in (trigger, content, doc, first))
            return _batch({
                "trigger": trigger.view(np.int64), "content": content.view(np.int64), "doc": doc, "first": first.astype(np.int32),
            })

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                p = Parse(text.as_py() or b"", length)
                held.append((p.trigger, p.contents(), np.full(len(p.first), doc, np.int64), p.first))
                size += len(p.first)
                if size >= 200_000:
                    yield made()
                    held, size = [], 0
        if size:
            yield made()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(x.as_py() or b"") for x in batch.column(1)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc", "raw"])


def _unpacked(value: pa.Scalar) -> bytes:
    import zstandard

    return zstandard.decompress(value.as_py())


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the phrases listed in column 2, as (trigger, content, doc, first)."""
        for batch in batches:
            held = []
            for k in range(batch.num_rows):
                wanted = batch.column(2)[k].values
                p = Parse(_unpacked(batch.column(1)[k]), length)
                own = np.flatnonzero(np.isin(p.first, wanted.to_numpy()))
                n = p.last[own] - p.first[own] + 1
                at = np.arange(int(n.sum())) + np.repeat(p.first[own] - (np.cumsum(n) - n), n)
                held.append((np.repeat(p.trigger[own], n), p.hashes(at, at + length), np.full(len(at), batch.column(0)[k].as_py(), np.int64), at))
                if sum(len(h[0]) for h in held) > 200_000:
                    yield _row_batch(held)
                    held = []
            if held:
                yield _row_batch(held)

    def _row_batch(held):
        trigger, content, doc, at = (np.concatenate([h[k] for h in held]) for k in range(4))
        return _batch({"trigger": trigger.view(np.int64), "content": content.view(np.int64), "doc": doc, "first": at.astype(np.int32)})

    return run


ROWS = "trigger long, content long, doc long, first int"
OPENED = "trigger long, doc long, first int, place int, phrase binary"


def _opened(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the phrases listed in column 2, with the trigger's place in them."""
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                raw, doc = _unpacked(batch.column(1)[k]), batch.column(0)[k].as_py()
                p = Parse(raw, length)
                for i in np.flatnonzero(np.isin(p.first, batch.column(2)[k].values.to_numpy())).tolist():
                    a = int(p.first[i])
                    out.append((int(p.trigger[i].view(np.int64)), doc, a, int(p.place[i]) - a, raw[a : int(p.last[i]) + length]))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["trigger", "doc", "first", "place", "phrase"])

    return run


def repeated_suffixes(phrases: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """(doc, start, stop) runs of windows that also start earlier, among (doc, first, bytes) phrases of one trigger."""
    suffixes = sorted((text[k : k + length], doc, first + k) for doc, first, text in phrases for k in range(len(text) - length + 1))
    again = sorted((doc, at) for (text, doc, at), before in zip(suffixes[1:], suffixes) if text == before[0])
    out: list[list[int]] = []
    for doc, at in again:
        if out and out[-1][0] == doc and out[-1][2] == at:
            out[-1][2] = at + 1
        else:
            out.append([doc, at, at + 1])
    return [tuple(r) for r in out]


def _sorted_suffixes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by trigger; a trigger has at most FEW of them and may span batches."""
        held, name, out = [], None, []

        def made() -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "stop"])

        for batch in batches:
            for trigger, doc, first, phrase in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4))):
                if trigger != name:
                    out += repeated_suffixes(held, length)
                    held, name = [], trigger
                held.append((doc, first, phrase))
            if len(out) > 50_000:
                yield made()
                out = []
        out += repeated_suffixes(held, length)
        if out:
            yield made()

    return run


def repeated_runs(raw: bytes, settled: np.ndarray, again: np.ndarray, new: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """(start, stop) of the maximal removed runs of one document.

    settled: starts of first phrases whose windows are new but for the (start, stop) runs in `again`; new: single
    windows that are first. All other windows repeat.
    """
    p = Parse(raw, length)
    if not p.windows:
        return np.zeros((0, 2), np.int64)
    repeats = np.ones(len(p.first), bool)
    repeats[np.isin(p.first, settled)] = False
    window = np.repeat(repeats, p.last - p.first + 1)
    for a, b in again.tolist():
        window[a:b] = True
    window[new] = False
    at = np.flatnonzero(window)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(at) > length)
    return np.column_stack((at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + length))


def _finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_runs, out_kept = [], []
            for k in range(batch.num_rows):
                raw = _unpacked(batch.column(1)[k])
                lists = [batch.column(c)[k] for c in (2, 3, 4, 5)]
                settled, start, stop, new = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in lists)
                runs = repeated_runs(raw, settled, np.column_stack((start, stop)), new, length).tolist()
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                out_runs.append([{"start": a, "stop": b} for a, b in runs])
                out_kept.append(b"".join([*kept, raw[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out_runs, kind), pa.array(out_kept, pa.binary())], names=["doc", "spans", "kept"]
            )

    return run


def _hot_triggers(rows: DataFrame, length: int) -> DataFrame:
    """(trigger, hot): fewer than HOT_SHARE triggers that hold over 1 / HOT_SHARE of the phrases of one document in HINT.

    A hint for the dealing of work, and nothing else: a trigger's phrases give the same result whether dealt over one
    task or many. All documents are parsed, and every phrase compared, below.
    """
    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(HINT)) == 0).mapInArrow(_phrases(length), ROWS)
    counts = common.cut(some.groupBy("trigger").agg(F.count("*").alias("n")).where(F.col("n") > HOT_LEAST))
    return common.hot_keys(counts, "trigger", least=HOT_LEAST, share=HOT_SHARE).select("trigger", F.lit(True).alias("hot"))


def _numbered(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, raw) rows with doc in document order, and the (doc, key) table where doc is not the key itself."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    whole = dict(rows.dtypes)["key"] in ("bigint", "int", "smallint", "tinyint")
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1 OR key IS NULL").limit(1).count()
    if whole and not twice:
        return rows.select(F.col("key").cast("long").alias("doc"), "raw"), None
    rows = rows.withColumn("tie", F.xxhash64("raw"))
    order = common.cut(
        rows.groupBy("key", "tie").agg(F.count("*").alias("copies")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
        .withColumn("doc", F.monotonically_increasing_id())
    )
    same = rows["tie"].eqNullSafe(order["tie"]) & rows["key"].eqNullSafe(order["key"])
    numbered = rows.join(order, same).select("doc", "raw").dropDuplicates(["doc"])
    return common.cut(numbered), order.select("doc", "key", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans array<struct<start, stop>>, kept binary) for every row of docs."""
    rows, names = _numbered(docs, key, text)
    # One exchange by trigger serves both the dictionary and the count of a trigger's phrases; the tasks
    # before it send each phrase once for a stretch of text, however often it is copied there. The phrases of a
    # trigger that is hot are dealt over many tasks by content; it needs no count.
    place = F.struct("doc", "first")
    hot = F.broadcast(_hot_triggers(rows, length))
    phrases = rows.mapInArrow(_phrases(length), ROWS).join(hot, "trigger", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("content", F.lit(SALTS))).otherwise(F.lit(0)))
    phrases = phrases.repartition("trigger", "salt")
    dictionary = phrases.groupBy("trigger", "salt", "content").agg(F.min(place).alias("at"), F.max("hot").alias("hot"))
    dictionary = dictionary.select("trigger", "salt", "hot", "at.doc", "at.first")
    counted = F.count("*").over(Window.partitionBy("trigger", "salt"))
    marked = dictionary.withColumn("n", F.when(F.col("hot"), F.lit(FEW + 1)).otherwise(counted))
    listed = lambda condition: F.collect_list(F.when(condition, F.col("first")))
    lists = common.cut(
        marked.groupBy("doc").agg(
            listed(F.col("n") <= FEW).alias("settled"), listed(F.col("n").between(2, FEW)).alias("few"), listed(F.col("n") > FEW).alias("many")
        )
    )
    # Texts move once, compressed: all three joins below read the same exchange by document. The filter stands after the
    # packing, where inner joins would put one of their own, so that the left join's plan is equal to theirs.
    rows = rows.mapInArrow(_packed, "doc long, raw binary").where("doc IS NOT NULL")
    some = lambda c: rows.join(lists.where(F.size(c) > 0).select("doc", c), "doc").select("doc", "raw", c)
    opened = some("few").mapInArrow(_opened(length), OPENED).repartition("trigger").sortWithinPartitions("trigger")
    runs = opened.mapInArrow(_sorted_suffixes(length), "doc long, start int, stop int")
    again = runs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("again"))
    again = again.select("doc", F.col("again.start").alias("start"), F.col("again.stop").alias("stop"))
    windows = some("many").mapInArrow(_windows(length), ROWS)
    firsts = windows.groupBy("trigger", "content").agg(F.min(place).alias("at")).select("at.doc", "at.first")
    new = firsts.groupBy("doc").agg(F.collect_list("first").alias("new"))
    joined = rows.join(lists.select("doc", "settled"), "doc", "left").join(again, "doc", "left").join(new, "doc", "left")
    joined = joined.select("doc", "raw", "settled", "start", "stop", "new")
    done = joined.mapInArrow(_finish(length), "doc long, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    sized = done.withColumn(
        "n_bytes",
        F.octet_length("kept") + F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"]),
    )
    if names is not None:
        sized = sized.join(names, "doc").withColumn(key, F.col("key"))
    else:
        sized = sized.withColumn(key, F.col("doc"))
    return sized.select(key, "n_bytes", "spans", "kept")
