"""Declared tables: logical and physical names, column kinds, primary keys, opaque columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("string", "number", "boolean", "json", "null")
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class RequestError(ValueError):
    """A request that the engine refuses (status 400 unless said otherwise)."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class TableSpec:
    """``columns``: logical name -> kind, in order; ``physical``: logical -> stored name where they differ."""

    name: str
    columns: dict[str, str]
    primary_key: tuple[str, ...]
    physical: dict[str, str] = field(default_factory=dict)
    stored_as: str | None = None
    encrypted: frozenset[str] = frozenset()

    def __post_init__(self):
        for what in (self.name, *self.columns, *self.physical.values()):
            if not NAME.match(what):
                raise RequestError(f"invalid identifier {what!r}")
        seen: dict[str, str] = {}
        for c in self.columns:
            for n in {c, self.physical.get(c, c)}:
                if seen.setdefault(n.lower(), c) != c:
                    raise RequestError(f"{self.name}: {n!r} names two columns")
        for c, kind in self.columns.items():
            if kind not in KINDS:
                raise RequestError(f"{self.name}.{c}: unknown kind {kind!r}")
        for c in self.encrypted:
            if self.columns.get(c) not in ("string", "json"):
                raise RequestError(f"{self.name}.{c}: only string and json columns can be encrypted")
        if not self.primary_key or len(set(self.primary_key)) < len(self.primary_key):
            raise RequestError(f"{self.name}: the primary key is empty or repeats a column")
        for c in self.primary_key:
            if c not in self.columns or c in self.encrypted:
                raise RequestError(f"{self.name}: {c!r} can't be part of the primary key")


class Catalog:
    """The declared tables and the DataFrames behind them."""

    def __init__(self, *specs: TableSpec):
        self.specs: dict[str, TableSpec] = {}
        self.frames: dict[str, DataFrame] = {}
        names: dict[str, str] = {}
        for s in specs:
            for n in {s.name, s.stored_as or s.name}:
                if names.setdefault(n.lower(), s.name) != s.name:
                    raise RequestError(f"{n!r} names two tables")
            self.specs[s.name] = s

    def spec(self, name: str) -> TableSpec:
        if name not in self.specs:
            raise RequestError(f"unknown table {name!r}")
        return self.specs[name]

    def bind(self, **frames: DataFrame) -> Catalog:
        """A catalog with the same declarations over these DataFrames (by logical name)."""
        out = Catalog(*self.specs.values())
        out.frames = {**self.frames, **frames}
        return out

    def load(self, spark: SparkSession, folder: str) -> Catalog:
        return self.bind(**{n: spark.read.parquet(f"{folder}/{s.stored_as or n}.parquet") for n, s in self.specs.items()})

    def scan(self, name: str) -> DataFrame:
        """All declared columns under their logical names; nothing else is read."""
        spec = self.spec(name)
        if name not in self.frames:
            raise RequestError(f"table {name!r} has no data")
        return self.frames[name].select(*(F.col(spec.physical.get(c, c)).alias(c) for c in spec.columns))


def raw_sql(spark: SparkSession, catalog: Catalog, sql: str) -> DataFrame:
    """Application SQL over the declared tables; anything but a query is refused."""
    text = re.sub(r"^(\s+|--[^\n]*(\n|$)|/\*.*?\*/)*", "", sql, flags=re.S)
    if classify_sql(text) != "read":
        raise RequestError("only queries are allowed here")
    for name in catalog.frames:
        catalog.scan(name).createOrReplaceTempView(name)
    return spark.sql(text)


def classify_sql(sql: str) -> str:
    """``read``, ``write`` or ``ddl`` by the first keyword after comments; a WITH counts as what follows it."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", " ", sql, flags=re.S).strip().upper()
    first = re.match(r"[A-Z]*", text)[0]
    if first == "WITH":
        body = re.search(r"\b(INSERT|UPDATE|DELETE|MERGE)\b", text)
        return "write" if body else "read"
    if first in ("SELECT", "VALUES", "TABLE", "EXPLAIN"):
        return "read"
    return "write" if first in ("INSERT", "UPDATE", "DELETE", "REPLACE", "MERGE") else "ddl"
