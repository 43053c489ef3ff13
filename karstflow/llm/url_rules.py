"""URL filters by a sort-merge range join.

Each url becomes a reversed-host key (``www.example.com`` -> ``com.example.www.``), so a rule
for a host and its subdomains is the key interval that starts with the rule's own key. Pages and
rules are range-partitioned and sorted together once; a sweep over each partition keeps the stack
of the nested rule intervals that hold the current key. A partition's opening stack are the rules
whose key is a prefix of its first key: an equi-join on the first keys' label prefixes (at most labels
x partitions of them) finds them, and they are dealt to the partition as rows that come first. The
driver sees one key for each partition and no rule; a task holds the rules of the open hosts.

Cases: a null url or one without ``://`` has empty host and path and gets the default verdict
unless a rule for the empty host exists; an empty table gives no rows; repeated rows are each
judged; of two rules with the same host and path the blocking one wins; a rule with a null host,
path or verdict is ignored. Extra columns of the pages are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def host_key(host):
    """Labels reversed, each closed by a full stop; the empty host's key is empty."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def label_prefixes(key: str) -> list[str]:
    """``com.example.`` -> ``['', 'com.', 'com.example.']``."""
    out, at = [""], 0
    while (at := key.find(".", at) + 1) > 0:
        out.append(key[:at])
    return out


def sweeper(default: str):
    """The sweep over sorted rows: rule rows (kind 0; those open before the partition's first key: -1) open
    their interval, page rows (kind 1) ask the stack."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # [key, {path: (verdict, name)}, path lengths from the longest]
        part = None

        def leave(key: str) -> None:
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()

        def enter(key: str, path: str, verdict: str, name: str) -> None:
            leave(key)
            if not stack or stack[-1][0] != key:
                stack.append([key, {}, []])
            rules = stack[-1][1]
            if rules.get(path, ("allow",))[0] != "block":
                rules[path] = (verdict, name)
            stack[-1][2] = sorted({len(p) for p in rules}, reverse=True)

        for batch in batches:
            ids, hosts, paths, names, verdicts = [], [], [], [], []
            cols = batch.to_pydict()
            for at, kind, key, path, page, host, verdict, name in zip(*(cols[c] for c in ("part", "kind", "key", "path", "page_id", "host", "verdict", "rule"))):
                if at != part:
                    part = at
                    stack.clear()
                if kind <= 0:
                    enter(key, path, verdict, name)
                    continue
                leave(key)
                best, best_len = None, -1
                for rule_key, rules, lengths in stack:
                    for n in lengths:
                        if n <= len(path) and path[:n] in rules:
                            if len(rule_key) + n >= best_len:  # a tie goes to the longer host, which lies higher
                                best, best_len = rules[path[:n]], len(rule_key) + n
                            break
                ids.append(page), hosts.append(host), paths.append(path)
                names.append(best[1] if best else None), verdicts.append(best[0] if best else default)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], ["page_id", "host", "path", "rule", "verdict"])

    return sweep


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url) under
    ``rules`` (host, path, verdict): the longest host and path that fit; else ``default``."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.select(F.lit(1).alias("kind"), host_key(F.col("host")).alias("key"), "path", "page_id", "host", F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("rule"))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    rules = rules.select(F.lit(0).alias("kind"), host_key(F.col("host")).alias("key"), "path", F.lit(None).cast("long").alias("page_id"), "host", "verdict", F.concat("host", "path").alias("rule"))
    # page_id deals a hot host's pages out over several partitions; rules sort before the pages of their key
    merged = rules.unionByName(urls).repartitionByRange(n, "key", "kind", "page_id", "path").sortWithinPartitions("key", "kind", "page_id", "path")
    # the partition's number is written down, so the order is fixed before its first keys are looked at
    frozen = settle(merged.withColumn("part", F.spark_partition_id()), "url_keys")
    firsts = frozen.groupBy("part").agg(F.min("key").alias("first")).collect()  # one row for each partition
    asked = spark.createDataFrame([(r.part, r.first, p) for r in firsts for p in label_prefixes(r.first)], "part int, first string, at string")
    opening = rules.join(F.broadcast(asked), rules.key == asked.at).select(*rules.columns, "part").withColumn("kind", F.lit(-1))  # `asked` is bounded
    rows = frozen.unionByName(opening).repartition(n, "part").sortWithinPartitions("part", F.col("kind") >= 0, "key", "kind", "page_id", "path")
    return rows.mapInArrow(sweeper(default), "page_id long, host string, path string, rule string, verdict string")
