"""Strictness of the query grammar, the catalog and the aggregate definitions."""

import pytest

from karstflow.operators import aggregates
from karstflow.plans.ast import Q, parse
from karstflow.plans.catalog import Catalog, RequestError, TableSpec, classify_sql
from karstflow.plans.planner import attach, check

PARCEL = TableSpec("parcel", {"id": "string", "label": "string", "sealed": "boolean", "weight": "number", "depot": "string", "seal": "string"}, ("id",), encrypted=frozenset({"seal"}))
EVENT = TableSpec("scan", {"id": "string", "parcelId": "string", "place": "string"}, ("id",))
CATALOG = Catalog(PARCEL, EVENT)


def leaf(op="=", value=1, **left):
    """A condition on one column against a literal, as the wire carries it."""
    return dict(type="simple", op=op, left=left or dict(type="column", name="weight"), right=dict(type="literal", value=value))


REL = {"correlation": {"parentField": ["id"], "childField": ["parcelId"]}, "subquery": {"table": "scan"}}


@pytest.mark.parametrize("bad", [
    {}, {"table": ""}, {"table": "parcel", "odd": 1}, {"table": "parcel", "limit": -1}, {"table": "parcel", "limit": 1.5}, {"table": "parcel", "limit": True},
    {"table": "parcel", "orderBy": [["id", "up"]]}, {"table": "parcel", "start": {"row": {"id": 1}, "exclusive": True}},
    {"table": "parcel", "orderBy": [["id", "asc"]], "start": {"row": {"id": 1}}}, {"table": "parcel", "orderBy": [["id", "asc"]], "start": {"row": {"id": 1}, "exclusive": 1}},
    {"table": "parcel", "where": leaf("~")}, {"table": "parcel", "where": leaf("IN", 1)}, {"table": "parcel", "where": leaf("=", [1])}, {"table": "parcel", "where": leaf("=", {"a": 1})},
    {"table": "parcel", "where": leaf("LIKE", 5)}, {"table": "parcel", "where": leaf(type="static", name="x")}, {"table": "parcel", "where": {"type": "xor", "conditions": []}},
    {"table": "parcel", "where": {"type": "and", "conditions": {}}}, {"table": "parcel", "where": {"type": "correlatedSubquery", "op": "SOME", "related": REL}},
    {"table": "parcel", "where": {"type": "correlatedSubquery", "op": "EXISTS", "related": REL, "scalar": True}},
    {"table": "parcel", "related": [{**REL, "system": "other"}]}, {"table": "parcel", "related": [{**REL, "hidden": 1}]},
    {"table": "parcel", "related": [{**REL, "correlation": {"parentField": ["id"], "childField": []}}]},
])
def test_refused(bad):
    with pytest.raises(RequestError):
        parse(bad)


def test_accepted():
    q = parse({"table": "parcel", "schema": "public", "where": {"type": "correlatedSubquery", "op": "EXISTS", "related": {**REL, "system": "permissions"}, "flip": True}, "related": [REL]})
    assert q.tables() == {"parcel", "scan"}


@pytest.mark.parametrize("q", [
    Q("nowhere"), Q("parcel").where("nothing", 1), Q("parcel").where("seal", "x"), Q("parcel").order_by("seal"), Q("parcel").order_by("nothing"),
    Q("parcel").where_exists(("scan", "seal", "id")), Q("parcel").where_exists(("scan", "id", "nothing")),
])
def test_unknown_and_encrypted_columns(q):
    with pytest.raises(RequestError):
        check(q.ast, CATALOG)


def test_exists_limit_zero_does_not_look_at_child_columns():
    check(Q("parcel").where_exists(("scan", "id", "nothing"), Q("scan").limit(0)).ast, CATALOG)


@pytest.mark.parametrize("make", [
    lambda: TableSpec("t", {"a": "string"}, ()), lambda: TableSpec("t", {"a": "string"}, ("b",)), lambda: TableSpec("t", {"a": "string"}, ("a", "a")),
    lambda: TableSpec("t", {"a": "text"}, ("a",)), lambda: TableSpec("t", {"a": "string", "A": "string"}, ("a",)), lambda: TableSpec("t", {"a b": "string"}, ("a b",)),
    lambda: TableSpec("t", {"a": "string"}, ("a",), encrypted=frozenset({"a"})), lambda: TableSpec("t", {"a": "string", "n": "number"}, ("a",), encrypted=frozenset({"n"})),
    lambda: TableSpec("t", {"a": "string", "b": "string"}, ("a",), {"a": "b"}), lambda: Catalog(PARCEL, TableSpec("Parcel", {"a": "string"}, ("a",))),
])
def test_bad_declarations(make):
    with pytest.raises(RequestError):
        make()


def test_aliases_of_nested_queries():
    for alias in ("", "label"):
        with pytest.raises(RequestError):
            attach(None, Q("parcel").related(alias, ("scan", "id", "parcelId")).ast, CATALOG, frozenset(), "")


@pytest.mark.parametrize("d", [
    [aggregates.Aggregate("1x", "parcel", {"depot": "o"}, "n")], [aggregates.Aggregate("x", "parcel", {"nothing": "o"}, "n")],
    [aggregates.Aggregate("x", "parcel", {"depot": "o"}, "n", {"s": "label"})], [aggregates.Aggregate("x", "parcel", {"depot": "o"}, None, {"s": "weight"})],
    [aggregates.Aggregate("x", "parcel", {}, "n")], [aggregates.Aggregate("x", "scan", {"parcelId": "id"}, "id", target="parcel")],
    [aggregates.Aggregate("x", "parcel", {"id": "id"}, "n", target="parcel")], [aggregates.Aggregate("x", "scan", {"parcelId": "label"}, "n", target="parcel")],
    [aggregates.Aggregate("x", "scan", {"parcelId": "id"}, "n", target="parcel"), aggregates.Aggregate("y", "scan", {"parcelId": "id"}, "n", target="parcel")],
])
def test_bad_aggregates(d):
    with pytest.raises(RequestError):
        aggregates.validate(d, CATALOG)


def test_classify_sql():
    assert [classify_sql(x) for x in ("/* DELETE */ SELECT 1", "-- x\nwith a as (select 1) select * from a", "WITH a AS (SELECT 1) DELETE FROM t", "insert into t values ('select')", "create table t(a int)")] == ["read", "read", "write", "write", "ddl"]
