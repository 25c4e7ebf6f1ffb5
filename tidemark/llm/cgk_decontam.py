"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of lower-cased words. The CGK walk reads a sequence from a start and, at
each step, writes the current word and moves on or stays as a random function of (step, word) says; words
near in edit distance give embeddings near in Hamming distance. An embedding of a window depends on the
window's start alone as long as the walk stays inside it, so one walk serves windows of every item's
size. Each of `walks` embeddings is sampled `samples` times at `coordinates` steps (bit sampling), and a
window that shares a sample with an item is a candidate of that item. Items are also entered from inner
starts, up to their end (every word of items of up to SHORT words, every `stride` words of longer ones); a sample counts
where the last word it reads is the item's own, so the windows of all starts together span the item. Walks are a
matter of chance, so they miss some matches. So every item is also cut into one segment more than the edits it may
hold: at least one segment is whole in any match, so equal segments lose no match, at the head or elsewhere, and
candidates are complete. Candidates are verified exactly: the least edit distance, in words, between the item and any
stretch of the document around the candidate place, must be at most (1 - least) of the item's words.

Items go to the tasks in blocks of at most `block` items, so what is sent has a fixed bound; each block is
one pass over the documents.

Defined results: null or empty texts and items match nothing; very long texts are read whole, their stretches verified
in blocks that overlap; of stretches at the same distance any gives the row, which carries the distance alone; repeated
rows each get their rows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

LEAST = 0.8
COMMON, RARE = 0.1, 2
#: Items of up to so many words are entered at every word, as few of their windows are free of edits.
SHORT = 28
CHUNK_BYTES = 1 << 21
#: Candidates made at a time; more of them wait, so that a segment of many items has a bound in memory.
PAIRS = 1 << 19
#: Places that lie this close are one row; longer rows skip the look at single words; stretches are verified in blocks.
WIDE, BLOCK = 16, 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x100000001B3
_INV = pow(_P, -1, 1 << 64)


@dataclass(frozen=True)
class Plan:
    """The random choices of a run, from one seed."""

    walks: int = 3
    steps: int = 16
    samples: int = 6
    coordinates: int = 6
    stride: int = 4
    seed: int = 20240

    def draws(self) -> list[list[np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        return [[np.sort(rng.choice(self.steps, self.coordinates, replace=False)) for _ in range(self.samples)] for _ in range(self.walks)]


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**k and P**-k modulo 2**64 for k below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _P, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ASCII-lower-cased words of UTF-8 bytes, and the byte where each word starts."""
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _powers(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9) ^ (ends - starts).astype(np.uint64), starts


def signatures(h: np.ndarray, starts: np.ndarray, plan: Plan, rare: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(sample number, signature of the window at each start, rare words among its samples, last place sampled).

    h ends with padding of over plan.steps words. rare marks words; without it counts and places are left out.
    """
    for walk, draws in enumerate(plan.draws()):
        at = starts.copy()
        sums = [np.zeros(len(starts), np.uint64) for _ in draws]
        counts, seen = [np.zeros(len(starts), np.int64) for _ in draws], [at - 1 for _ in draws]
        for step in range(max(int(d[-1]) for d in draws) + 1):
            word = h[at]
            for k, d in enumerate(draws):
                if step in d:
                    sums[k] = (sums[k] ^ word) * np.uint64(0x9E3779B97F4A7C15)
                    if rare is not None:
                        counts[k] += rare[at] & (at != seen[k])
                        seen[k] = at.copy()
            coin = (word * np.uint64((0xD6E8FEB86659FD93 + 2 * (walk * 1000 + step) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)) >> np.uint64(63)
            at += coin.astype(at.dtype)
        for k, s in enumerate(sums):
            yield walk * plan.samples + k, s ^ (s >> np.uint64(31)), counts[k], seen[k]


def grams(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each position on; positions near the end see zeros."""
    out = np.zeros(len(h), np.uint64)
    for k in range(m):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out[: len(h) - k] += h[k:]
    return out ^ (out >> np.uint64(32))


def _runs(starts: np.ndarray, group: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, group) of the runs of starts of one group that follow each other within `gap` words."""
    order = np.lexsort((starts, group))
    s, g = starts[order], group[order]
    new = np.ones(len(s), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] - s[:-1] > gap)
    at = np.flatnonzero(new)
    return s[at], s[np.append(at[1:] - 1, len(s) - 1)], g[at]


class Places:
    """Which items a signature stands for: for each (signature, item) the least and the greatest word of it there."""

    def __init__(self, sig: np.ndarray, item: np.ndarray, word: np.ndarray):
        order = np.lexsort((word, item, sig))
        sig, item, word = sig[order], item[order], word[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (item[1:] != item[:-1])
        at = np.flatnonzero(new)
        last = np.append(at[1:] - 1, len(sig) - 1) if len(at) else at
        self.item, self.low, self.high = item[at], word[at], word[last]
        self.keys, self.first = np.unique(sig[at], return_index=True)
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def rows(self, sig: np.ndarray, starts: np.ndarray, gap: int) -> Iterator[np.ndarray]:
        """(first place, last place, item, start) rows: where the item would begin; about PAIRS of them at a time.

        Starts of one signature that follow each other, as in repetitive text, are one run, and an item's words of
        one signature are one range: rows grow with runs times items, not with starts times words.
        """
        near = np.flatnonzero(self.bits[(sig >> np.uint64(48)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, sig[near]), len(self.keys) - 1)
        hit = self.keys[at] == sig[near]
        if not hit.any():
            return
        first, last, key = _runs(starts[near[hit]], at[hit], gap)
        lo = self.first[key]
        n = np.append(self.first[1:], len(self.item))[key] - lo
        part = np.cumsum(n) // PAIRS
        for k in np.unique(part):
            some = np.flatnonzero(part == k)
            ends = np.cumsum(n[some])
            j = np.arange(int(ends[-1])) - np.repeat(ends - n[some], n[some]) + np.repeat(lo[some], n[some])
            yield np.column_stack((np.repeat(first[some], n[some]) - self.high[j], np.repeat(last[some], n[some]) - self.low[j], self.item[j], np.repeat(first[some], n[some])))


class Items:
    """The lookup tables of one block of items."""

    def __init__(self, items: list[tuple[int, str]], plan: Plan, least: float = LEAST):
        self.plan, self.ids, self.words = plan, [], []
        for item_id, text in items:
            h, _ = word_hashes((text or "").encode("utf-8", "surrogatepass"))
            if len(h):
                self.ids.append(item_id)
                self.words.append(h)
        pad = np.zeros(plan.steps + 1, np.uint64)
        entry: list[tuple[int, int]] = []
        flat, starts, ends, at = [], [], [], 0
        for i, h in enumerate(self.words):
            for s in range(0, len(h), 1 if len(h) <= SHORT else plan.stride):
                entry.append((i, s))
                starts.append(at + s)
                ends.append(at + len(h))
            flat += [h, pad]
            at += len(h) + len(pad)
        self.entry = np.array(entry, np.int64).reshape(-1, 2)
        # A word of many items (COMMON of them) says little: samples of such words alone would meet most
        # windows, so a sample is kept only with RARE other words; the further samples make up for it.
        every, use = np.unique(np.concatenate([np.unique(h) for h in self.words] or [np.zeros(0, np.uint64)]), return_counts=True)
        self.common = every[use > max(2, COMMON * len(self.words))]
        self.tables: list[Places] = []
        if entry:
            joined = np.concatenate(flat)
            rare = ~np.isin(joined, self.common) & (joined != 0)
            for _, sig, n, last in signatures(joined, np.array(starts, np.int64), plan, rare):
                # A sample that reads past the item's end holds words the document need not have.
                inside = last < np.array(ends, np.int64)
                most = np.zeros(len(self.words), np.int64)
                np.maximum.at(most, self.entry[inside, 0], n[inside])
                kept = np.flatnonzero(inside & (n >= np.minimum(RARE, most[self.entry[:, 0]])))
                self.tables.append(Places(sig[kept], self.entry[kept, 0], self.entry[kept, 1]))
        # One segment more than the edits an item may hold: one is whole in any match.
        self.segments: dict[int, Places] = {}
        cuts: dict[int, list[tuple[int, int, int]]] = {}
        for i, h in enumerate(self.words):
            edge = np.linspace(0, len(h), int((1 - least) * len(h) + 1e-9) + 2).astype(int).tolist()
            for s, e in zip(edge, edge[1:]):
                cuts.setdefault(e - s, []).append((int(grams(h[s:e], e - s)[0]), i, s))
        for m, rows in cuts.items():
            self.segments[m] = Places(np.array([r[0] for r in rows], np.uint64), *(np.array([r[k] for r in rows], np.int64) for k in (1, 2)))

        # A stretch within the allowed edits holds all but `slack` of the item's distinct rare words. The
        # table knows (item, word) pairs by a short hash: it may count a word too many, never one too few.
        self.size = np.array([len(h) for h in self.words], np.int64)
        self.slack = ((1 - least) * self.size + 1e-9).astype(np.int64)
        own = [np.setdiff1d(h, self.common) for h in self.words]
        self.needed = np.array([len(o) for o in own], np.int64) - self.slack
        bits = max(16, int(self.size.sum() * 64).bit_length())
        self.shift, self.holds = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        for i, o in enumerate(own):
            self.holds[self._slot(np.uint64(i), o)] = True

    def _slot(self, item, word):
        with np.errstate(over="ignore"):
            mixed = (word ^ (item * np.uint64(0x94D049BB133111EB))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def plausible(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows whose stretch holds enough of the item's words; wide rows, which stand for many places, all stay."""
        keep = rows[:, 1] - rows[:, 0] > WIDE
        size = np.where(keep, 0, self.size[rows[:, 2]])
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            slack = int(self.slack[rows[own[0], 2]])
            wide = int((rows[own, 1] - rows[own, 0]).max())
            span = np.arange(-slack, n + slack + wide)
            for at in range(0, len(own), 4096):
                part = rows[own[at : at + 4096]]
                where = np.clip(part[:, 0, None] + span, 0, len(h) - 1)
                held = self.holds[self._slot(part[:, 2].astype(np.uint64)[:, None], h[where])]
                keep[own[at : at + 4096]] = held.sum(1) >= self.needed[part[:, 2]]
        return rows[keep]

    def candidates(self, h: np.ndarray, starts: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(text, item, first place, last place) rows: where in h the item would begin; begin: where each text does."""
        found = [np.zeros((0, 4), np.int64)]
        if self.tables:
            for n, sig, *_ in signatures(h, starts, self.plan):
                found += [self.plausible(h, rows) for rows in self.tables[n].rows(sig, starts, WIDE)]
        for m, places in self.segments.items():
            found += [self.plausible(h, rows) for rows in places.rows(grams(h, m)[starts], starts, WIDE)]
        rows = np.concatenate(found)
        text = np.searchsorted(begin, rows[:, 3], "right") - 1
        return np.unique(np.column_stack((text, rows[:, 2], rows[:, 0], rows[:, 1])), axis=0)


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """(least edit distance between item and any stretch of words, end of such a stretch), the first one."""
    col = np.zeros(len(words) + 1, np.int64)
    ramp = np.arange(len(words) + 1)
    for k, w in enumerate(item.tolist()):
        step = np.minimum(col[:-1] + (words != w), col[1:] + 1)
        new = np.concatenate(([k + 1], step))
        col = np.minimum.accumulate(new - ramp) + ramp
    return int(col.min()), int(col.argmin())


def matches(items: Items, texts: list[str], least: float) -> list[tuple[int, int, int, int]]:
    """(text number, item id, least distance, stretches found) of each matching text and item."""
    pad = np.zeros(items.plan.steps + 1, np.uint64)
    flat, starts, begin, end, at = [], [], [], [], 0
    for text in texts:
        h, _ = word_hashes((text or "").encode("utf-8", "surrogatepass"))
        flat += [h, pad]
        starts.append(np.arange(at, at + len(h)))
        begin.append(at)
        end.append(at + len(h))
        at += len(h) + len(pad)
    if not flat:
        return []
    h = np.concatenate(flat)
    rows = items.candidates(h, np.concatenate(starts), np.array(begin))
    best: dict[tuple[int, int], list[int]] = {}

    def verify(n: int, i: int, a: int, b: int) -> None:
        words, slack = items.words[i], int(items.slack[i])
        reach = len(words) + slack
        # Long stretches in blocks that overlap by as much as a match can span.
        for at in range(a, max(a + 1, b - reach), BLOCK):
            distance, _ = best_stretch(words, h[at : min(b, at + BLOCK + reach)])
            if distance <= slack:
                now = best.setdefault((n, i), [distance, 0])
                now[0] = min(now[0], distance)
                now[1] += 1

    # Rows come by text, item and place: the stretches of one item in one text that meet are verified as one.
    held: list[int] = []
    for n, i, first, last in rows.tolist():
        slack = int(items.slack[i])
        a, b = max(begin[n], first - slack), min(end[n], last + len(items.words[i]) + slack)
        if held and held[:2] == [n, i] and a <= held[3]:
            held[3] = max(held[3], b)
            continue
        if held:
            verify(*held)
        held = [n, i, a, b]
    if held:
        verify(*held)
    return [(n, items.ids[i], d, c) for (n, i), (d, c) in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", least: float = LEAST, plan: Plan = Plan(), block: int = 20_000, block_chars: int = 1 << 24,
) -> DataFrame:
    """(key, item_id, distance): each document with each item it holds, once for each row of docs."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, distance int"
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    n, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-chars // block_chars))
    bare = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    out = None
    for b in range(blocks):
        # One block of items at a time is on the driver; only its task function, with a bounded table, goes on.
        part = benchmark.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == b).select(item_key, item_text)
        items = [(r[0], r[1]) for r in part.orderBy(item_key).collect()]

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            ready = Items(items, plan, least)
            for batch in batches:
                keys, texts = batch.column(0), batch.column(1)
                held, first, size = [], 0, 0
                for k in range(batch.num_rows + 1):
                    if k == batch.num_rows or size >= CHUNK_BYTES:
                        found = matches(ready, held, least)
                        if found:
                            yield pa.RecordBatch.from_arrays(
                                [
                                    keys.take(pa.array([first + f[0] for f in found], pa.int64())),
                                    pa.array([f[1] for f in found], item_type),
                                    pa.array([f[2] for f in found], pa.int32()),
                                ],
                                names=["doc", "item", "distance"],
                            )
                        held, first, size = [], k, 0
                    if k < batch.num_rows:
                        held.append(texts[k].as_py())
                        size += len(held[-1] or "")

        made = bare.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out.select(F.col("doc").alias(key), F.col("item").alias(item_key), "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """Rows of docs that hold no item.

    Rows are told apart by their place in their file: of rows that share an id, or have none, those that hold an
    item go and the others stay.
    """
    rows, rid = common.with_row_id(docs)
    hit = common.cut(contaminated(rows.select(rid, text), benchmark, rid, text, **options).select(rid))
    return common.without_rows(rows, rid, hit).select(*docs.columns)
