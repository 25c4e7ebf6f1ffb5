"""64-bit hashes of all words of a batch of texts at once, by prefix sums over their bytes.

A word is a maximal run of bytes other than the six ASCII white-space ones. Each byte stands for a fixed random number; a
word's hash is the polynomial of its bytes' numbers, read off as a difference of prefix sums, and mixed with its length.
Texts are worked through in stretches of about STRETCH bytes, cut at white space, so that a very long text costs no more
memory than many short ones; a single longer word is a stretch of its own.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

STRETCH = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ONE = np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Polynomial:
    """One hash: its byte numbers and the powers of its base and of the base's inverse, made as far as they are needed."""

    def __init__(self, seed: int, lower: bool):
        made = mixed(np.arange(1, 258, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.table = made[:256].copy()
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(made[256]) | 1
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << n.bit_length()
            run = lambda r: np.multiply.accumulate(np.concatenate([[_ONE], np.full(n - 1, r, np.uint64)]))
            self.up, self.down = run(np.uint64(self.base)), run(np.uint64(pow(self.base, -1, 1 << 64)))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Words(NamedTuple):
    """Words of one stretch: bytes, where words start and end in them, and the text of each, as a place in the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    return np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), offsets


def stretches(texts: pa.Array) -> Iterator[Words]:
    """All words of a batch of texts; null texts have none."""
    data, offsets = _bytes(texts)
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + STRETCH)
        if stop < end:
            # Between two texts, else at white space, else as far as the word goes.
            k = int(np.searchsorted(offsets, stop, side="right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                white = np.flatnonzero(_SPACE[data[at:stop]])
                if len(white):
                    stop = at + int(white[-1]) + 1
                else:
                    last = int(offsets[k + 1])
                    white = np.flatnonzero(_SPACE[data[stop:last]])
                    stop = stop + int(white[0]) if len(white) else last
        part = data[at:stop]
        solid = ~_SPACE[part]
        first = np.zeros(len(part) + 1, bool)
        inside = offsets[(offsets >= at) & (offsets < stop)] - at
        first[inside] = True
        before = np.concatenate([[False], solid[:-1]]) & ~first[:-1]
        after = np.concatenate([solid[1:], [False]]) & ~first[1:]
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        yield Words(part, starts, ends, np.searchsorted(offsets, starts + at, side="right") - 1)
        at = stop


def by_text(texts: pa.Array, poly: Polynomial) -> Iterator[np.ndarray]:
    """The word hashes of every text of a batch, text by text."""
    done, open_at, open_parts = 0, -1, []
    for w in stretches(texts):
        h = poly(w.data, w.starts, w.ends)
        if not len(h):
            continue
        cuts = np.flatnonzero(np.diff(w.text)) + 1
        edge = [0, *cuts.tolist(), len(h)]
        for a, b in zip(edge, edge[1:]):
            k = int(w.text[a])
            if k != open_at:
                if open_at >= 0:
                    yield np.concatenate(open_parts) if len(open_parts) > 1 else open_parts[0]
                    done += 1
                while done < k:
                    yield np.zeros(0, np.uint64)
                    done += 1
                open_at, open_parts = k, []
            open_parts.append(h[a:b])
    if open_at >= 0:
        yield np.concatenate(open_parts) if len(open_parts) > 1 else open_parts[0]
        done += 1
    while done < len(texts):
        yield np.zeros(0, np.uint64)
        done += 1
