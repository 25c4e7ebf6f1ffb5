"""How far the sources of a language differ in their words: chunk factorisation, exact integer shares.

A chunk is what stands between white space, and no term reaches over white space. Texts are only cut at white space: a
task counts the chunks of its documents and hands on one row for each chunk of a language, with the counts of all
(lang, source) groups inside. Rows meet by chunk, so each globally distinct chunk is tokenised once, and its terms are joined
back to the chunk's counts.

Distinct documents need care, since a document may hold a term in several chunks. A chunk's documents are a lower
bound of its term's, and the sum over the term's chunks is an upper one; a term is kept where the first reaches the
limit and is dropped where the second does not. Only the chunks of terms in between need the names of their documents:
tasks hand on the names for chunks that stay below the limit, so never more than limit - 1 in a row.

Shares are whole numbers, p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V)), computed in decimals. Distances of all pairs
of sources are sums over blocks of terms: a task fills a matrix of TILE sources by the terms of one block and adds up
rows of differences, so no pair of sources is ever formed term by term.

Within a task chunks are told apart by two 64-bit hashes (a difference in the second alone is an error); between tasks by
their text. Defined results: null text, lang and source are ''; blank texts have no terms but their group exists; very long
texts and chunks are read whole; repeated rows are documents like any other; equal values are ordered by the item's UTF-8
bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import groupby
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common, word_hashes

#: A term is a run of letters A-Z, a-z and of all characters outside ASCII; only A-Z are lower-cased.
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCALE, PRIOR = 1_000_000_000, 5
#: Counts a task holds before it hands them on; sources in a tile; terms in a block, about.
HELD, TILE, TERMS = 1_500_000, 128, 2048
#: Rows of a narrow table up to this many go to wide rows by broadcast.
SENT = 500_000
col = F.col


def _sent(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, in columns that are sorted together."""
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0) if len(columns[0]) else np.zeros(0, bool)
    return np.flatnonzero(np.concatenate([[True], new]))[: len(columns[0])]


def _lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind), mask=None if mask is None else pa.array(mask))


class _Block:
    """(chunk, document, times) of many documents as arrays, and each chunk's text once."""

    def __init__(self):
        self.first, self.second = word_hashes.Polynomial(1, False), word_hashes.Polynomial(2, False)
        self.clear()

    def clear(self):
        self.parts, self.bytes, self.size, self.docs, self.tags = [], [], 0, 0, []

    def add(self, texts: pa.Array, lang: list[str], group: list[int]) -> None:
        for w in word_hashes.stretches(texts):
            h = self.first(w.data, w.starts, w.ends)
            at = np.lexsort((h, w.text))
            runs = _runs(w.text[at], h[at])
            one = at[runs]
            self.parts.append((h[one], w.text[one] + self.docs, np.diff(np.append(runs, len(at))), self.second(w.data, w.starts, w.ends)[one], w.starts[one] + sum(map(len, self.bytes)), (w.ends - w.starts)[one]))
            self.bytes.append(w.data)
            self.size += len(one)
        self.docs += len(texts)
        self.tags.append((lang, group))

    def rows(self, limit: int, block: int) -> Iterator[pa.RecordBatch]:
        """One row for each chunk of a language: its documents, the counts of groups, and the documents' names if few."""
        if not self.parts:
            return
        h, doc, n, check, start, length = (np.concatenate(c) for c in zip(*self.parts))
        data = np.concatenate(self.bytes)
        langs = sorted({x for lang, _ in self.tags for x in lang})
        number = {x: k for k, x in enumerate(langs)}
        lang, group = np.array([number[x] for tag, _ in self.tags for x in tag]), np.array([x for _, tag in self.tags for x in tag], np.int64)
        # A long text may come in several stretches: its counts of a chunk are added up first.
        at = np.lexsort((doc, group[doc], h, lang[doc]))
        h, doc, n, check, start, length = (c[at] for c in (h, doc, n, check, start, length))
        if (check[1:] != check[:-1])[h[1:] == h[:-1]].any():
            raise ValueError("two chunks share a 64-bit hash")
        own, by = lang[doc], group[doc]
        r = _runs(own, h, by, doc)
        n, h, doc, own, by, start, length = np.add.reduceat(n, r), h[r], doc[r], own[r], by[r], start[r], length[r]
        entry, chunk = _runs(own, h, by), _runs(own, h)
        docs = np.diff(np.append(chunk, len(h)))
        few = docs < limit
        kept = np.repeat(few, docs)
        in_chunk = np.searchsorted(entry, np.append(chunk, len(h)))
        for a in range(0, len(chunk), 100_000):
            b = min(a + 100_000, len(chunk))
            c, e = chunk[a:b], slice(in_chunk[a], in_chunk[b])
            s, w = start[c], length[c]
            flat = data[np.repeat(s - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(int(w.sum()))]
            text = pa.StringArray.from_buffers(len(c), pa.py_buffer(np.concatenate([[0], np.cumsum(w)]).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))
            lo, hi = int(c[0]), int(chunk[b]) if b < len(chunk) else len(h)
            names = doc[lo:hi][kept[lo:hi]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [text, pa.array([langs[k] for k in own[c].tolist()], pa.string()), pa.array(docs[a:b], pa.int64()),
                 _lists(by[entry[e]], np.diff(in_chunk[a : b + 1]), pa.int64()),
                 _lists(np.add.reduceat(n, entry)[e].astype(np.int64), np.diff(in_chunk[a : b + 1]), pa.int64()),
                 pa.array([block] * len(c), pa.int64()), _lists(names, np.where(few[a:b], docs[a:b], 0), pa.int32())],
                names=["chunk", "lang", "docs", "groups", "ns", "block", "names"])


def _counted(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = _Block(), 0
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                if not block.docs:
                    name = part.column(0)[0].as_py()
                block.add(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist())
                if block.size >= HELD:
                    yield from block.rows(limit, name)
                    block.clear()
        yield from block.rows(limit, name)

    return run


def _merged(limit: int):
    """Rows come sorted by (chunk, lang): one row for each, with the terms of the chunk, tokenised once."""

    def whole(rows: pa.Table | pa.RecordBatch) -> pa.RecordBatch:
        chunk, lang = rows.column("chunk"), rows.column("lang")
        differ = lambda c: pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        new = differ(chunk)
        at = np.flatnonzero(np.concatenate([[True], new | differ(lang)]))
        row_of = np.cumsum(np.bincount(at, minlength=len(chunk))) - 1
        docs = np.add.reduceat(rows.column("docs").to_numpy(), at)

        def entries(column):
            return pc.list_flatten(column).to_numpy(zero_copy_only=False), np.repeat(row_of, pc.list_value_length(column).to_numpy(zero_copy_only=False))

        group, owner = entries(rows.column("groups"))
        n, _ = entries(rows.column("ns"))
        order = np.lexsort((group, owner))
        group, owner, n = group[order], owner[order], n[order]
        r = _runs(owner, group)
        n, group, lengths = np.add.reduceat(n, r), group[r], np.bincount(owner[r], minlength=len(at))
        # A document's name: its block's number and its place there.
        name, of = entries(rows.column("names"))
        name = np.repeat(rows.column("block").to_numpy(), pc.list_value_length(rows.column("names")).to_numpy(zero_copy_only=False)) + name
        few = docs < limit
        name, of = name[few[of]], of[few[of]]
        terms, last = [], None
        for k, text in zip(at.tolist(), chunk.take(pa.array(at)).to_pylist()):
            if text != last:
                last, found = text, [t.translate(LOWER) for t in TERM.findall(text)]
            terms.append(found)
        return pa.RecordBatch.from_arrays(
            [lang.take(pa.array(at)), pa.array(docs), _lists(group, lengths, pa.int64()), _lists(n, lengths, pa.int64()), _lists(name, np.bincount(of, minlength=len(at)), pa.int64()), pa.array(terms, pa.list_(pa.string()))],
            names=["lang", "docs", "groups", "ns", "names", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            chunk = rows.column("chunk")
            # The last chunk may go on in the next batch.
            same = pc.equal(chunk, chunk[len(chunk) - 1]).to_numpy(zero_copy_only=False)
            cut = len(chunk) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield whole(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield whole(held)

    return run


def term_counts(docs: DataFrame, groups: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(g, lang, term, n) of the kept terms, and (lang, term), the terms in at least `limit` documents of a language.

    docs has no nulls; groups(lang, source, g) numbers the groups.
    """
    given = docs.join(_sent(groups), ["lang", "source"]).select(F.monotonically_increasing_id().alias("name"), "text", "lang", "g")
    parts = given.mapInArrow(_counted(limit), "chunk string, lang string, docs long, groups array<long>, ns array<long>, block long, names array<int>")
    met = parts.repartition("chunk").sortWithinPartitions("chunk", "lang")
    chunks = common.stored(met.mapInArrow(_merged(limit), "lang string, docs long, groups array<long>, ns array<long>, names array<long>, terms array<string>").where(F.size("terms") > 0))
    held = chunks.select("lang", "docs", F.explode(F.array_distinct("terms")).alias("term"))
    bounds = common.stored(held.groupBy("lang", "term").agg(F.max("docs").alias("least"), F.sum("docs").alias("most")).where(col("most") >= limit))
    open_terms = _sent(bounds.where(col("least") < limit).select("lang", "term"))
    named = chunks.where(F.size("names") > 0).select("lang", F.explode(F.array_distinct("terms")).alias("term"), "names").join(open_terms, ["lang", "term"])
    exact = named.select("lang", "term", F.explode("names").alias("name")).distinct().groupBy("lang", "term").agg(F.count("*").alias("docs"))
    kept = common.stored(bounds.where(col("least") >= limit).select("lang", "term").unionByName(exact.where(col("docs") >= limit).select("lang", "term")))
    counted = chunks.select("lang", F.explode("terms").alias("term"), F.arrays_zip("groups", "ns").alias("e")).join(_sent(kept), ["lang", "term"])
    counts = counted.select("lang", "term", F.inline("e")).groupBy(col("groups").alias("g"), "lang", "term").agg(F.sum("ns").alias("n"))
    return common.stored(counts), kept


def share(n: Column, total: Column, kept: Column) -> Column:
    """p as a long; null where no term is kept."""
    wide = lambda c: c.cast("decimal(22,0)")
    above, below = F.lit(SCALE).cast("decimal(10,0)") * wide(n + PRIOR), wide(total + PRIOR * kept)
    return F.when(kept > 0, 1 + F.call_function("div", above, F.when(kept > 0, below)))


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (lang, block, x, y): sums of |p - q| over the block's terms for all pairs of two tiles.

    Every source of the two tiles has a row without a term, which brings its base share, its share of terms that it does not
    hold. Sums run over the terms that some source of the cell holds; how many they are goes with them.
    """
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    for (lang, _, x, y), cell in groupby(rows(), key=lambda r: r[:4]):
        sources, base, tile, terms, at = {}, [], [], {}, []
        for _, _, _, _, own, source, term, p in cell:
            i = sources.setdefault(source, len(sources))
            if i == len(base):
                base.append(0)
                tile.append(own)
            if term is None:
                base[i] = p
            else:
                at.append((i, terms.setdefault(term, len(terms)), p))
        shares = np.repeat(np.array(base, np.int64)[:, None], len(terms), 1)
        if at:
            i, j, p = np.array(at, np.int64).T
            shares[i, j] = p
        names, tile = list(sources), np.array(tile)
        for k, name in enumerate(names):
            other = np.flatnonzero((tile == (y if tile[k] == x else x)) & (np.arange(len(names)) != k))
            n, sums = len(other), np.abs(shares[other] - shares[k]).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array([names[i] for i in other], pa.string()), pa.array(sums, pa.int64()), pa.array([len(terms)] * n, pa.int64())],
                names=["lang", "source", "item", "value", "seen"])


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def pair_distances(groups: DataFrame, counts: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language.

    groups(lang, source, base, tile, tiles), counts(lang, source, term, p), languages(lang, kept, blocks).
    """
    cells = lambda: F.explode(F.transform(F.sequence(F.lit(0), col("tiles") - 1), lambda k: F.struct(F.least(k, col("tile")).alias("x"), F.greatest(k, col("tile")).alias("y"))))
    shown = ["lang", "block", "c.x", "c.y", "tile", "source", "term", "p"]
    placed = groups.join(languages, "lang")
    seeds = placed.withColumn("block", F.explode(F.sequence(F.lit(0), col("blocks") - 1))).select("*", F.lit(None).cast("string").alias("term"), col("base").alias("p"), cells().alias("c")).select(*shown)
    held = counts.join(placed.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"])
    held = held.withColumn("block", F.pmod(F.xxhash64("term"), col("blocks")).cast("int")).select("*", cells().alias("c")).select(*shown)
    keys = ["lang", "block", "x", "y"]
    dealt = seeds.unionByName(held).repartition(*keys).sortWithinPartitions(*keys)
    sums = dealt.mapInArrow(_pair_sums, "lang string, source string, item string, value long, seen long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    left, right = groups.select("lang", "source", col("base").alias("a")), groups.select("lang", col("source").alias("item"), col("base").alias("b"))
    whole = sums.join(left, ["lang", "source"]).join(right, ["lang", "item"]).join(languages.select("lang", "kept"), "lang")
    return whole.select("lang", "source", "item", (col("value") + (col("kept") - col("seen")) * F.abs(col("a") - col("b"))).alias("value"))


def audit(docs: DataFrame, limit: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and each source's `top` terms above its language."""
    docs = docs.select(*[F.coalesce(col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    named = common.stored(docs.select("lang", "source").distinct())
    numbered = common.stored(named.withColumn("g", F.monotonically_increasing_id()))
    counts, kept = term_counts(docs, numbered, limit)
    counts = common.stored(counts.drop("lang").join(_sent(numbered), "g").select("lang", "source", "term", "n"))
    in_lang = common.stored(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept")).join(in_lang.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    languages = named.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").fillna(0, ["kept", "total"])
    languages = common.stored(languages.withColumn("blocks", F.greatest(F.lit(1), F.ceil(col("kept") / TERMS)).cast("int")))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    tiles = F.greatest(F.lit(1), F.ceil(col("sources") / TILE)).cast("int")
    groups = named.join(held, ["lang", "source"], "left").fillna(0, ["total"]).join(languages.select("lang", "kept", "sources"), "lang")
    groups = common.stored(groups.select("lang", "source", "total", "kept", F.coalesce(share(F.lit(0).cast("long"), col("total"), col("kept")), F.lit(0)).alias("base"), tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile")))
    shares = common.stored(counts.join(_sent(groups.select("lang", "source", "total", "kept")), ["lang", "source"]).select("lang", "source", "term", share(col("n"), col("total"), col("kept")).alias("p")))
    pairs = pair_distances(groups.select("lang", "source", "base", "tile", "tiles"), shares, languages.select("lang", "kept", "blocks"))
    whole = in_lang.join(languages.select("lang", "total", "kept"), "lang").select("lang", "term", share(col("n"), col("total"), col("kept")).alias("q"))
    above = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", col("term").alias("item"), (col("p") - col("q")).alias("value"))
    return _ranked(pairs, "pair").unionByName(_ranked(above, "term").where(col("rank") <= top))
