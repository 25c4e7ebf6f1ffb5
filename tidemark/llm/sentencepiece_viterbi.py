"""SentencePiece encoding and decoding with a batched numpy Viterbi search.

Texts are cut into words that no piece can cross; each distinct word of a batch is segmented once. Words
of equal length advance together: at every end position the hashes of all substrings that end there probe
the sorted hashes of the pieces, and a vectorised maximum over the candidates stores the backpointer.

Unigram models: the maximum of the summed piece scores. BPE models: the result of the merges is the one
segmentation whose neighbours are all stable (merging the two pieces' characters gives those two pieces
back), so a candidate counts only if its piece is stable after the last piece of the best prefix; exactly
one candidate does. Stability of a pair is worked out once per worker and remembered.

Defined results: null text has null ids; empty text has none; a character outside the vocabulary becomes
its UTF-8 byte pieces, or, where the model has none, a run of such characters becomes one unknown id,
which reads as a mark; but for that, decoding gives the text back, and the model's own space mark reads as
a space. Very long texts are encoded whole, one text a step. Repeated rows are encoded alike; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: What the unknown id reads as.
UNKNOWN_TEXT = " \u2047 "
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F
CHUNK_UNITS, WORDS_KEPT, PAIRS_KEPT, SLOT_BITS = 1 << 21, 300_000, 1_000_000, 20


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a serialised protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """The pieces of a model file and the tables the search needs."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, kinds = [], [], []
        self.kind, self.prefix, trim, charsmap = UNIGRAM, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix, trim, charsmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
        if trim or charsmap or USER in kinds or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models without text normalisation and user-defined pieces are supported")
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        raw = [b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds)]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw_length = np.array([len(r) for r in raw], np.int64)
        self.raw_offset, self.raw_bytes = np.cumsum(self.raw_length) - self.raw_length, np.frombuffer(b"".join(raw), np.uint8)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (NORMAL, UNUSED)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after an inner space: words can't be cut at spaces")
        usable = self.ids if self.kind == UNIGRAM else {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        self.longest = max(map(len, usable))
        keys = np.array([self._hash(p) for p in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(list(usable.values()), np.int32)[order]
        assert len(np.unique(keys)) == len(keys), "two pieces share a hash"
        self.heads = np.zeros(1 << 20, bool)
        self.heads[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.score = np.array(self.scores, np.float32)
        self.floor = np.float32(min(self.scores[i] for i in self.ids.values())) - np.float32(10)
        inner = sorted({c for p in self.ids if len(p) > 1 for c in p} - {SPACE})
        many = "[" + "".join(map(re.escape, inner)) + "]+"
        self.words = re.compile(f"{SPACE}*{many}|{SPACE}+|.", re.S)
        self.forget_pairs()
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offset, self.length, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + (ord(c) + 1) * MIX) & (1 << 64) - 1
        return h

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: always the best-scored neighbours, the leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces stays as it is; -1 is a character outside the vocabulary."""
        base = len(self.pieces) + 1
        code = (left.astype(np.int64) + 1) * base + right + 1
        # One probe of a direct table answers most pairs; the sorted list knows all of them.
        slot = ((code.view(np.uint64) * np.uint64(BASE)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_flags[slot]
        missed = np.flatnonzero(self.slot_codes[slot] != code)
        if len(missed):
            out[missed] = self._listed_pairs(code[missed], base)
            self.slot_codes[slot[missed]] = code[missed]
            # Pairs of one slot may have met here: the flag must be that of the code the slot now holds.
            held = self.slot_codes[slot[missed]] == code[missed]
            self.slot_flags[slot[missed][held]] = out[missed][held]
        return out

    def _listed_pairs(self, code: np.ndarray, base: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        fresh = np.unique(code[self.pair_codes[at] != code])
        if len(fresh):
            if len(self.pair_codes) > PAIRS_KEPT:
                self.pair_codes, self.pair_flags = self.pair_codes[:1], self.pair_flags[:1]
                fresh = np.unique(code)
            flags = np.ones(len(fresh), bool)
            for n, c in enumerate(fresh.tolist()):
                a, b = c // base - 1, c % base - 1
                if a >= 0 and b >= 0:
                    x, y = self.pieces[a], self.pieces[b]
                    flags[n] = self.merged(x + y) == [x, y]
            codes = np.concatenate([self.pair_codes, fresh])
            order = np.argsort(codes, kind="stable")
            self.pair_codes, self.pair_flags = codes[order], np.concatenate([self.pair_flags, flags])[order]
            at = np.searchsorted(self.pair_codes, code)
        return self.pair_flags[at]

    def forget_pairs(self) -> None:
        self.pair_codes, self.pair_flags = np.array([-1], np.int64), np.ones(1, bool)
        self.slot_codes, self.slot_flags = np.full(1 << SLOT_BITS, -1, np.int64), np.ones(1 << SLOT_BITS, bool)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids one word after the other, how many each word has) of words of one length, all advancing together."""
        n, w = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(w, n).astype(np.uint64)
        prefix = np.zeros((w, n + 1), np.uint64)
        power = np.array([pow(BASE, k, 1 << 64) for k in range(n + 1)], np.uint64)
        for k in range(n):
            prefix[:, k + 1] = prefix[:, k] * np.uint64(BASE) + (points[:, k] + np.uint64(1)) * np.uint64(MIX)
        best = np.full((w, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        token = np.full((w, n + 1), -1, np.int32)
        step = np.ones((w, n + 1), np.int32)
        for j in range(1, n + 1):
            starts = np.arange(max(0, j - self.longest), j)
            h = prefix[:, j, None] - prefix[:, starts] * power[j - starts]
            # A bit table of the hashes' heads spares most substrings the search.
            rows, cols = np.nonzero(self.heads[(h >> np.uint64(44)).astype(np.int64)])
            probe = h[rows, cols]
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            hit = self.keys[at] == probe
            rows, cols, found = rows[hit], cols[hit], self.key_ids[at[hit]]
            ids, value = np.full(h.shape, -1, np.int32), np.full(h.shape, -np.inf, np.float32)
            ids[rows, cols] = found
            none = ids[:, -1] < 0
            if self.kind == UNIGRAM:
                value[rows, cols] = self.score[found] + best[rows, starts[cols]]
            else:
                ok, later = np.ones(len(rows), bool), starts[cols] > 0
                ok[later] = self.stable_pairs(token[rows[later], starts[cols[later]]], found[later])
                value[rows[ok], cols[ok]] = 0
            if none.any():
                value[none, -1] = best[none, j - 1] + self.floor if self.kind == UNIGRAM else -1
            k = value.argmax(1)
            every = np.arange(w)
            best[:, j] = value[every, k]
            step[:, j] = j - starts[k]
            token[:, j] = ids[every, k]
        # Backpointers, all words together: END marks words that have reached their start.
        end, at, every, columns = -2, np.full(w, n), np.arange(w), []
        while at.any():
            live = at > 0
            columns.append(np.where(live, token[every, at], end))
            at = at - np.where(live, step[every, at], 0)
        table = np.stack(columns[::-1], axis=1)
        used = table != end
        ids, count = table[used], used.sum(1)
        if (ids == -1).any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for r in np.flatnonzero((table == -1).any(1)).tolist():
                parts[r] = self._spelled(words[r], parts[r].tolist())
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids.astype(np.int32), count

    def _spelled(self, word: str, tokens: list[int]) -> np.ndarray:
        """Tokens with characters outside the vocabulary (-1) as bytes, or one unknown id for a run of them."""
        ids, at = [], 0
        for t in tokens:
            if t >= 0:
                ids.append(t)
                at += len(self.pieces[t])
                continue
            if self.byte:
                ids.extend(self.byte[b] for b in word[at].encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += 1
        return np.array(ids, np.int32)

    def learn(self, words: set[str]) -> None:
        """Segment words not met before and append their ids to the flat store."""
        if len(self.known) + len(words) > WORDS_KEPT:
            self.reset()
        by_length: dict[int, list[str]] = {}
        for word in words:
            if word not in self.known:
                by_length.setdefault(len(word), []).append(word)
        for n, group in by_length.items():
            most = max(1, (1 << 19) // n)
            for at in range(0, len(group), most):
                part = group[at : at + most]
                ids, count = self.segment(part)
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
                self.flat[self.used : self.used + len(ids)] = ids
                self.known.update(zip(part, range(len(self.offset), len(self.offset) + len(part))))
                self.offset = np.concatenate([self.offset, self.used + np.cumsum(count) - count])
                self.length = np.concatenate([self.length, count])
                self.used += len(ids)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts one after the other, how many each text has)."""
        lead = SPACE if self.prefix else ""
        cut = [self.words.findall(lead + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*cut)
        if len(fresh) > WORDS_KEPT and len(texts) > 1:
            half = len(texts) // 2
            parts = [self.encode_flat(some) for some in (texts[:half], texts[half:])]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.learn(fresh)
        sizes = np.array([len(ws) for ws in cut], np.int64)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
        length = self.length[index]
        ids = self.flat[_runs(self.offset[index], length)]
        to = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))]
        if not self.byte:
            # Characters outside the vocabulary in a row are one unknown id, over the ends of words too.
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            again[to[:-1][to[:-1] < len(ids)]] = False
            to = to - np.concatenate(([0], np.cumsum(again)))[to]
            ids = ids[~again]
        return ids, np.diff(to)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, count = self.encode_flat(texts)
        return np.split(ids, np.cumsum(count)[:-1])

    def decode_flat(self, ids: np.ndarray, count: np.ndarray, null: np.ndarray) -> pa.StringArray:
        """The texts of token ids that lie one after the other, `count` of them for each text."""
        length = self.raw_length[ids]
        data = self.raw_bytes[_runs(self.raw_offset[ids], length)]
        to = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(count)))]
        if self.prefix and len(data):
            led = to[:-1][(np.diff(to) > 0)]
            led = led[data[led] == 32]
            data = np.delete(data, led)
            to = to - np.searchsorted(led, to, "left")
        starts = to[:-1][to[:-1] < len(data)]
        try:
            if (data[starts] & 0xC0 == 0x80).any():
                raise ValueError("a text starts inside a character")
            data.tobytes().decode("utf-8")
        except ValueError:
            raw = data.tobytes()
            return pa.array([None if n else raw[a:b].decode("utf-8", "replace") for a, b, n in zip(to, to[1:], null)], pa.string())
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
        return pa.StringArray.from_buffers(len(count), pa.py_buffer(to.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()), valid, int(null.sum()))

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_flat(ids, np.array([len(ids)]), np.zeros(1, bool))[0].as_py()


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... length[k] places of each, one after the other."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


@lru_cache(maxsize=2)
def model_of(data: bytes) -> Model:
    return Model(data)


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first row, rows) slices of about CHUNK_UNITS units each; a longer row is a slice of its own."""
    part = np.cumsum(sizes) // CHUNK_UNITS
    edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]))
    yield from ((int(a), int(b - a)) for a, b in zip(edge, edge[1:]) if b > a)


def _lists(ids: np.ndarray, count: np.ndarray, null: np.ndarray) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
    offsets = pa.array(ends, pa.int32(), mask=np.concatenate((null, [False])))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def _encoded(docs: DataFrame, model: bytes, text: str, ids: str, decoded: str | None) -> DataFrame:
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    made = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    names = [*kept, *[f.name for f in made]]
    where = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            column = batch.column(where)
            for at, n in _chunks(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) + 1):
                part = batch.slice(at, n)
                texts = part.column(where)
                null = texts.is_null().to_numpy(zero_copy_only=False)
                flat, count = m.encode_flat(texts.fill_null("").to_pylist())
                out = [_lists(flat, count, null)] + ([m.decode_flat(flat, count, null)] if decoded else [])
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=names)

    return docs.select(*kept).mapInArrow(run, T.StructType([*[docs.schema[c] for c in kept], *made]))


def encode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs plus an array<int> column of token ids; a column of that name gives way."""
    return _encoded(docs, model, text, ids, None)


def encode_and_decode(docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode, and decode of its ids, in one pass over the rows: what `decode(encode(docs))` returns."""
    return _encoded(docs, model, text, ids, decoded)


def decode(tokens: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """tokens plus the text its ids stand for; null ids give null."""
    kept = [c for c in tokens.columns if c != text]
    names = [*kept, text]
    where = kept.index(ids)
    schema = T.StructType([*[tokens.schema[c] for c in kept], T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of(model)
        for batch in batches:
            counts = pc.list_value_length(batch.column(where)).fill_null(0).to_numpy(zero_copy_only=False)
            for at, n in _chunks(counts + 1):
                part = batch.slice(at, n)
                lists = part.column(where)
                out = m.decode_flat(
                    lists.flatten().to_numpy(zero_copy_only=False), counts[at : at + n].astype(np.int64), lists.is_null().to_numpy(zero_copy_only=False)
                )
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=names)

    return tokens.select(*kept).mapInArrow(run, schema)
