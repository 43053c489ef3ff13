"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in k = floor(m * error_rate) edits. Cut into k + 1 pieces,
at least one piece is then found unchanged: an Aho-Corasick automaton reports all exact piece hits
of a text, and Myers' bit-parallel distance verifies the window around each hit. Texts are compared
lower-cased and with runs of white space as one blank. Documents are only scanned: no shuffle.

The automaton is sent to the tasks, so its size is checked: items are taken in blocks of at most
``ITEM_CHARS`` characters, one at a time. The items of one block go with the plan. More blocks mean
more scans: each writes down what it finds before the next begins, so a task holds one automaton
whatever the number of items, and the hits are joined to the documents by (doc_id, text hash).

Cases: a null or empty text has no matches; a null or blank item matches nothing; an item too short for
an edit (m * error_rate < 1) must be found whole and unchanged; repeated items and rows each count;
an empty table on either side gives no matches; extra columns pass through (a column of the
result's own name is kept and the new one gets an underscore).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import byte_batches, fresh, settle

#: Characters of test items that one automaton may hold, about 0.5 GB of memory.
ITEM_CHARS = 4_000_000
HIT = ArrayType(StructType([StructField("item_id", LongType()), StructField("distance", IntegerType())]))


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of nearly equal length."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]


def best_distance(item: str, window: str, most: int) -> int:
    """The least edit distance of ``item`` to any part of ``window``, or most + 1 (Myers 1999, in one big integer)."""
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, min(m, most + 1)
    for c in window:
        eq = where.get(c, 0)
        cross = (((eq & up) + up) ^ up) | eq | down
        plus, minus = (down | ~(cross | up)) & full, up & cross
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best = score
        plus, minus = (plus << 1) & full, (minus << 1) & full  # a match may start anywhere: no carry in
        eq |= down
        up, down = (minus | ~(eq | plus)) & full, plus & eq
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items, found = [], {}
        for item_id, text in items:
            item = plain(text or "")
            errors = int(len(item) * error_rate)
            for at, piece in pieces(item, errors):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, errors))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.any = bool(found)
        if self.any:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, least distance) of every item found in ``text``."""
        if not self.any or not text:
            return []
        text = plain(text)
        starts: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(text):
            for i, at in uses:
                starts.setdefault(i, set()).add(end + 1 - n - at)
        out = []
        for i, at in starts.items():
            item_id, item, errors = self.items[i]
            best, done = errors + 1, 0
            if any(s >= 0 and text.startswith(item, s) for s in at):
                best = 0
            elif errors:
                windows: list[list[int]] = []
                for s in sorted(at):  # overlapping windows become one, so a text is read once for each item at most
                    a, b = max(0, s - errors), s + len(item) + errors
                    if windows and a <= windows[-1][1]:
                        windows[-1][1] = b
                    else:
                        windows.append([a, b])
                for a, b in windows:
                    best = min(best, best_distance(item, text[a:b], errors))
            if best <= errors:
                out.append((item_id, best))
        return sorted(out, key=lambda x: (x[0] is None, x))


_kept: dict[str, Matcher] = {}


def scanner(items: list[tuple[int, str]], name: str, error_rate: float):
    """Fills the column ``name``; a Python worker makes the automaton once for all its tasks of a scan."""
    scan_id = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if scan_id not in _kept:
            _kept.clear()
            _kept[scan_id] = Matcher(items, error_rate)
        for batch in batches:
            at = batch.schema.get_field_index(name)
            found = [_kept[scan_id].matches(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            new = pa.array([[{"item_id": i, "distance": d} for i, d in x] for x in found], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return scan


def find_items(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.06) -> tuple[DataFrame, str]:
    """``documents`` with a column of the (item_id, distance) found in each text, and that column's name."""
    byte_batches(documents.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    n_blocks = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS
    name = fresh(documents, "matches")

    def block(b: int) -> list[tuple[int, str]]:
        return sorted((tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()), key=str)

    if n_blocks == 1:
        out = documents.withColumn(name, F.lit(None).cast(HIT))
        return out.mapInArrow(scanner(block(0), name, error_rate), out.schema), name
    of, of_h, h = (fresh(documents, c) for c in ("found_in", "found_in_hash", "text_hash"))
    texts = documents.select(F.col("doc_id").cast("long").alias(of), F.xxhash64(F.col("text").cast("string")).alias(of_h), F.col("text").cast("string").alias("text"))
    found = []
    for b in range(n_blocks):
        rows = texts.withColumn(name, F.lit(None).cast(HIT))
        rows = rows.mapInArrow(scanner(block(b), name, error_rate), rows.schema).where(F.size(name) > 0)
        found.append(settle(rows.groupBy(of, of_h).agg(F.first(name).alias(name)), "hits"))  # a row may stand several times
    hits = reduce(DataFrame.unionByName, found).groupBy(of, of_h).agg(F.flatten(F.collect_list(name)).alias(name))  # the items of one text
    rows = documents.withColumn(h, F.xxhash64(F.col("text").cast("string")))
    rows = rows.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(h) == F.col(of_h)), "left")
    return rows.select(*documents.columns, F.coalesce(name, F.array().cast(HIT)).alias(name)), name


def contaminated(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.06) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids (ascending) and min_distance (null if none)."""
    found, name = find_items(documents.select("doc_id", "text"), benchmark, error_rate)
    hits = F.col(name)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.size(hits) > 0).alias("contaminated"), F.size(hits).alias("n_items"),
        F.array_sort(F.transform(hits, lambda x: x["item_id"])).alias("item_ids"), F.array_min(F.transform(hits, lambda x: x["distance"])).alias("min_distance"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, error_rate: float = 0.06) -> DataFrame:
    """The documents without a match, with their own columns."""
    found, name = find_items(documents, benchmark, error_rate)
    return found.where(F.size(name) == 0).select(*documents.columns)
