"""Secret scan over an incremental blob ledger (DataFrame functions only).

A text is content-addressed by SHA-256: a blob. The ledger has two tables that only grow:

    blobs  one row for each blob ever seen: the rule versions applied to it, the spans they found, how many
           rows of the last table held it, and how many versions were applied to it then
    paths  one row for each (path, blob) ever seen and the scan in which it first was: every historical
           version of every path

A scan takes the distinct blobs of a table, applies to each only the rule versions that the ledger does not list
for it, and joins findings back to the paths: those of the table, or all of history. A changed rule has a
new version, so only that rule runs again.

Texts in which no rule's gate (a literal or short pattern without which the rule can't match) is open are
addressed, but not moved: their findings are known to be none. The other texts, once each, meet the ledger by
blob; a blob that a large share of all rows hold is dealt over several tasks where paths meet findings.

Matches are leftmost and non-overlapping per rule; a match whose measured group is too short is dropped
after matching. Positions count code points, end exclusive.

Defined results: null text is the empty blob, with no findings; repeated rows each get the findings, and are
one path; null keys are a path of their own; very long texts are scanned whole; spans that start together come in
the order of the rules; an empty table gives an empty result and adds nothing to a ledger; other columns of docs
are not read, and pass through `mask` whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """gate: a literal or pattern without which the rule can't match; least: shortest measured group."""

    kind: str
    pattern: str
    group: int
    least: int
    gate: str

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.kind}|{self.pattern}|{self.group}|{self.least}".encode()).hexdigest()[:16]


#: The three base rules, then the rules this operator adds.
BASE_RULES = (
    Rule("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, "(?i:passw|secret|token|api_?key)"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "array<struct<start:bigint,ord:int,stop:bigint,kind:string,version:string>>"


def _gate(rule: Rule, text: Column) -> Column:
    plain = not any(c in "[(?{\\" for c in rule.gate)
    return F.contains(text, F.lit(rule.gate)) if plain else F.rlike(text, F.lit(rule.gate))


def _pattern(rule: Rule) -> str:
    """A pattern without a shorter alternative may state its least length itself: the runs are the same."""
    if rule.group == 0 and rule.pattern == "[0-9a-f]+":
        return "[0-9a-f]{%d,}" % rule.least
    return rule.pattern


def _spans(rule: Rule, order: int, text: Column, whole: Column) -> Column:
    """Positions from the lengths of what lies between matches and of the matches."""
    pattern = _pattern(rule)
    between = F.transform(F.split(text, pattern, -1), F.length)
    measured = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length)
    lengths = F.transform(whole, F.length)
    pieces = F.arrays_zip(between.alias("gap"), lengths.alias("run"), measured.alias("of"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + F.coalesce(x["run"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(order).alias("ord"), stop.alias("stop"),
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
        )
        kept = F.when(F.coalesce(x["of"] >= rule.least, F.lit(False)), F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(stop.alias("at"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(pieces, empty, step, lambda acc: acc["out"])


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs(blob, text, seen array<string>, ...) plus spans: those of unseen rule versions only."""
    text, none = F.col("text"), F.array().cast("array<string>")
    seen = F.coalesce(F.col("seen"), none)
    todo = [~F.array_contains(seen, r.version) & _gate(r, text) for r in rules]
    found = blobs.select(
        "*", *[F.when(t, F.regexp_extract_all(text, F.lit(_pattern(r)), F.lit(0))).alias(f"m{i}") for i, (r, t) in enumerate(zip(rules, todo))]
    )
    parts = [
        F.when(F.coalesce(F.size(f"m{i}"), F.lit(0)) > 0, _spans(r, i, text, F.col(f"m{i}"))).otherwise(F.array().cast(SPAN))
        for i, r in enumerate(rules)
    ]
    return found.select(*blobs.columns, F.sort_array(F.concat(*parts)).alias("spans"))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def addressed(docs: DataFrame, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text) for every row of docs; text is null where no rule's gate is open."""
    open_ = F.coalesce(reduce(or_, [_gate(r, F.col(text)) for r in rules]), F.lit(False))
    return docs.select(F.col(key).alias("path"), blob_id(F.col(text)).alias("blob"), F.when(open_, F.col(text)).alias("text"))


@dataclass(frozen=True)
class Ledger:
    blobs: DataFrame
    paths: DataFrame

    def write(self, folder: str) -> "Ledger":
        """Stored as two tables; what is read back is what later scans start from."""
        self.blobs.write.parquet(f"{folder}/blobs")
        self.paths.write.parquet(f"{folder}/paths")
        return Ledger.read(self.blobs.sparkSession, folder)

    @staticmethod
    def read(spark: SparkSession, folder: str) -> "Ledger":
        return Ledger(spark.read.parquet(f"{folder}/blobs"), spark.read.parquet(f"{folder}/paths"))


def update(rows: DataFrame, ledger: Ledger | None = None, rules=RULES, scan: int = 1) -> Ledger:
    """The ledger after a scan of rows(path, blob, text), as `addressed` makes them with these rules or more."""
    none, current = F.array().cast("array<string>"), F.array(*[F.lit(r.version) for r in rules])
    here = rows.groupBy("blob").agg(F.first("text", ignorenulls=True).alias("text"), F.count("*").alias("copies"))
    paths = rows.groupBy("path", "blob").agg(F.lit(scan).alias("scan"))
    if ledger is None:
        known = here.withColumns({"seen": none, "known": F.array().cast(SPAN)})
    else:
        known = here.join(ledger.blobs.select("blob", F.col("versions").alias("seen"), F.col("spans").alias("known")), "blob", "full_outer")
        both = paths["path"].eqNullSafe(F.col("p")) & (paths["blob"] == F.col("b"))
        old = ledger.paths.select(F.col("path").alias("p"), F.col("blob").alias("b"))
        paths = ledger.paths.unionByName(paths.join(old, both, "left_anti"))
    found = scan_blobs(known, rules)
    fresh = F.when(F.col("copies").isNotNull(), F.array_except(current, F.coalesce("seen", none))).otherwise(none)
    blobs = found.select(
        "blob", F.array_union(F.coalesce("seen", none), fresh).alias("versions"),
        F.sort_array(F.concat(F.coalesce("known", F.array().cast(SPAN)), "spans")).alias("spans"),
        F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.size(fresh).alias("applied"),
    )
    return Ledger(blobs, paths)


def _hits(ledger: Ledger, rules) -> DataFrame:
    """(blob, spans, copies) of the blobs that have spans of the current rule versions."""
    current = F.array(*[F.lit(r.version) for r in rules])
    return ledger.blobs.select("blob", F.filter("spans", lambda s: F.array_contains(current, s["version"])).alias("spans"), "copies").where(F.size("spans") > 0)


def findings(rows: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """(path, spans) for each of the rows that the ledger was last updated with; empty array: none."""
    hits = _hits(ledger, rules)
    hot = common.hot_keys(hits, "blob", "copies")
    joined = common.salted_join(rows.select("path", "blob"), hits.drop("copies"), "blob", hot)
    return joined.select("path", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def history(ledger: Ledger, rules=RULES) -> DataFrame:
    """(path, blob, scan, spans) for every version of every path that has findings."""
    hits = _hits(ledger, rules).drop("copies")
    hot = common.hot_keys(ledger.paths.groupBy("blob").agg(F.count("*").alias("n")), "blob")
    return common.salted_join(ledger.paths, hits, "blob", hot, "inner").select("path", "blob", "scan", "spans")


def as_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by the mask."""
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), out.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, empty, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))))
    )


def mask(docs: DataFrame, rules=RULES, text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """docs, its own columns, with the spans of every text masked.

    Only texts with an open gate are moved; the others pass by. Each blob is scanned once; its spans travel back
    to the rows that hold it.
    """
    blob, spans = common.free_name(docs, "blob"), common.free_name(docs, "spans")
    open_ = F.coalesce(reduce(or_, [_gate(r, F.col(text)) for r in rules]), F.lit(False))
    likely = common.stored(docs.where(open_))  # few rows; read twice below
    rows = likely.select(F.lit(None).cast("int").alias("path"), blob_id(F.col(text)).alias("blob"), F.col(text).alias("text"))
    found = common.cut(_hits(update(rows, ledger, rules), rules))
    hot = common.hot_keys(found, "blob", "copies").select(F.col("blob").alias(blob))
    hits = found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = common.salted_join(likely.withColumn(blob, blob_id(F.col(text))), hits, blob, hot)
    masked = joined.withColumn(text, F.when(F.col(spans).isNotNull(), redact(F.col(text), F.col(spans))).otherwise(F.col(text)))
    return masked.select(*docs.columns).unionByName(docs.where(~open_))
