"""Sources: keyed pages, COPY dumps, logs."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..plans.catalog import Catalog


def lookup(table: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """The rows of a batch of keys."""
    return table.join(keys.select(*pk).distinct(), pk, "left_semi")


def page(catalog: Catalog, table: str, after: dict[str, Any] | None, size: int) -> tuple[DataFrame, dict[str, Any] | None]:
    """A page in key order and the cursor of the next one (None at the end): one row more is read to know."""
    spec = catalog.spec(table)
    order = [(c, "asc") for c in spec.primary_key]
    rows = catalog.scan(table)
    if after is not None:
        rows = rows.where(exprs.after_cursor(order, spec.columns, after, True))
    rows = rows.orderBy(*exprs.sort_columns(order)).limit(size + 1)
    keys = rows.select(*spec.primary_key).collect()  # a page's keys
    return rows.limit(size), keys[size - 1].asDict() if len(keys) > size and size else None


def pages(catalog: Catalog, table: str, size: int):
    """All pages of a table, each a DataFrame."""
    after: dict[str, Any] | None = None
    while True:
        rows, after = page(catalog, table, after, size)
        yield rows
        if after is None:
            return


def unescape(field: Column) -> Column:
    r"""One COPY field: ``\N`` is NULL; ``\\ \n \r \t \b \f \v`` are undone from left to right, ``\x`` is x."""
    marks = F.create_map(*(F.lit(x) for pair in {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}.items() for x in pair))
    # one pass from the left cuts the field into escapes and runs without any
    parts = F.regexp_extract_all(field, F.lit(r"(?s)(\\.|[^\\]+|\\$)"), F.lit(1))
    mark = lambda x: F.substring(x, 2, 1)
    undone = F.transform(parts, lambda x: F.when(x.startswith("\\") & (F.length(x) == 2), F.coalesce(F.try_element_at(marks, mark(x)), mark(x))).otherwise(x))
    return F.when(field == r"\N", F.lit(None)).otherwise(F.array_join(undone, ""))


def copy_rows(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the data lines (value) of a COPY block, as strings; the end mark is left out."""
    fields = F.split("value", "\t", -1)
    return lines.where(r"value <> '\\.'").select(*(unescape(fields[i]).alias(c) for i, c in enumerate(columns)))


def copy_blocks(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dump: each ``COPY table (columns) FROM stdin`` block as a DataFrame of strings.

    Lines are numbered by their place in the file; only the headers (one for each table) come to the driver."""
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id())
    heads = lines.where(F.col("value").rlike(r"^COPY \S+ \(.*\) FROM stdin;$")).orderBy("n").collect()
    ends = [r.n for r in lines.where(r"value = '\\.'").orderBy("n").select("n").collect()]
    out: dict[str, DataFrame] = {}
    for head, end in zip(heads, ends):
        table, columns = re.match(r"^COPY (\S+) \((.*)\) FROM stdin;$", head.value).groups()
        names = [c.strip().strip('"') for c in columns.split(",")]
        body = lines.where((F.col("n") > head.n) & (F.col("n") < end)).select("value")
        out[table.split(".")[-1].strip('"')] = copy_rows(body, names)
    return out


def log_entries(logs: DataFrame, source: str | None = None, level: int | None = None, since: int | None = None, last: int = 1000) -> DataFrame:
    """The last entries (id, source, priority, message) that pass the filters, at most 5000."""
    if source is not None:
        logs = logs.where(F.col("source") == source)
    if level is not None:
        logs = logs.where(F.col("priority") <= level)
    if since is not None:
        logs = logs.where(F.col("id") > since)
    return logs.orderBy(F.desc("id")).limit(min(last, 5000))
