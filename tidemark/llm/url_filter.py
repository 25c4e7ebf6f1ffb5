"""URL filter by expression expansion and hashed lookup (DataFrame functions only).

A URL expands into every (host suffix, path prefix) pair a rule could name: all label suffixes of the
host, and the path's prefixes of the lengths that occur among the rules. Pairs meet the rules by an
equi-join on the first four bytes of a SHA-256 digest; the full digest then confirms, and of the
confirmed rules the one with the longest host, then the longest path, wins.

Rules of up to BROADCAST_BYTES meet the pages in their tasks; more are joined by a shuffle in which keys that a large
share of all pages have are split.

Defined results: a null url, or one without `://`, has an empty host and path and matches no rule; a URL
that no rule fits gets the default verdict; very long urls are read whole; repeated rows each get a result; ties can't occur, as a rule
pair is unique (a pair given twice with both verdicts blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The rules of the registered query (verdict, host, path prefix).
DEFAULT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
BROADCAST_BYTES = 32 << 20


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """(verdict, rule_host, rule_path) rows from a Python sequence, as a literal relation."""
    made = F.array(*[F.struct(F.lit(v).alias("rule_verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(made))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return common.ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def classify(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages plus host, path, rule and verdict; the caller's columns of those names give way."""
    row, host, path = (common.free_name(pages, s) for s in ("row", "host", "path"))
    ready = rules.select(
        F.col("rule_verdict"), F.col("rule_host"), F.col("rule_path"), _digest(F.col("rule_host"), F.col("rule_path")).alias("rule_digest")
    ).groupBy("rule_host", "rule_path", "rule_digest").agg(F.max("rule_verdict").alias("rule_verdict"))
    # One aggregate over the rules: how many there are, and which path lengths and host depths occur.
    shape = ready.agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.max(F.size(F.split("rule_host", "\\."))).alias("depth"),
        F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")), F.lit(0)).alias("bytes"),
    ).first()
    ready = ready.withColumn("rule_key", F.substring("rule_digest", 1, 8))
    # About 150 bytes a rule besides its names.
    small = shape["bytes"] + 150 * shape["n"] <= BROADCAST_BYTES
    lengths = F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>")
    labels = F.split(F.col(host), "\\.")
    depth = F.least(F.size(labels), F.lit(shape["depth"] or 0))
    suffixes = F.transform(
        F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length(F.col(path))), lambda n: F.substr(F.col(path), F.lit(1), n)
    )
    pairs = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(_digest(h, p).alias("digest"))))
    )
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.withColumns({row: F.monotonically_increasing_id(), host: host_of(F.col(url)), path: path_of(F.col(url))}).select(
        *kept, row, host, path
    )
    keyed = split.select(*kept, row, host, path, F.explode_outer(pairs).alias("pair")).withColumn("rule_key", F.substring("pair.digest", 1, 8))
    if small:
        hits = keyed.join(F.broadcast(ready), "rule_key", "left")
    else:
        # A common suffix, such as com with /, is a key of most pages: it is dealt over many tasks. Row names must not
        # change between the readings.
        keyed = common.cut(keyed.withColumn("rule_key", F.coalesce("rule_key", F.hex(F.col(row)))))
        hot = common.hot_keys(keyed.groupBy("rule_key").agg(F.count("*").alias("n")), "rule_key")
        hits = common.salted_join(keyed, ready, "rule_key", hot)
    sound = F.col("pair.digest") == F.col("rule_digest")
    best = F.max(
        F.when(
            sound,
            F.struct(
                F.length("rule_host").alias("h"), F.length("rule_path").alias("p"),
                F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
            ),
        )
    ).alias("best")
    return (
        hits.groupBy(row)
        .agg(*[F.first(c).alias(c) for c in (*kept, host, path)], best)
        .select(
            *kept, F.col(host).alias("host"), F.col(path).alias("path"), F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
