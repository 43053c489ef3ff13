"""Named queries, permissions, paging, desires and field manifests."""

import pytest

from karstflow.operators import desires
from karstflow.plans.ast import Q, cmp
from karstflow.plans.catalog import Catalog, RequestError, TableSpec
from karstflow.plans.registry import Registry, batches, guarded, may, server_where, with_permission
from karstflow.plans.planner import flat
from karstflow.streaming import fields

T = TableSpec("t", {"k": "number", "owner": "string", "doc": "json"}, ("k",))


@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(T).bind(t=spark.createDataFrame([(i, None if i == 4 else "ab"[i % 2], "{}") for i in range(9)], "k long, owner string, doc string"))


def test_registry_and_permissions(catalog):
    r = Registry()
    r.add("t.mine", lambda args, user: Q("t").where("owner", user).limit(args["n"]))
    (q,) = r.resolve([("t.mine", {"n": 2})], "a")
    assert [x.k for x in flat(q, catalog).collect()] == [0, 2]
    assert r.resolve([("none", 1), ("t.mine", {"n": 1})], "a", tolerate=True)[0].limit == 1
    with pytest.raises(RequestError):
        r.resolve([("none", 1)])
    with pytest.raises(KeyError):
        r.resolve([("t.mine", {})], "a", tolerate=True)
    rule = cmp("owner", "=", "a")
    assert may(catalog, "t", {"k": 2}, rule) and not may(catalog, "t", {"k": 1}, rule) and may(catalog, "t", {"k": 1}, rule, admin=True) and not may(catalog, "t", {"k": 99}, rule, admin=True)
    assert flat(with_permission(Q("t").where("k", ">", 4).ast, rule), catalog).count() == 2
    assert flat(Q("t").where(server_where(rule, True)).ast, catalog).count() == 9
    with pytest.raises(RequestError):
        may(catalog, "t", {}, rule)
    with pytest.raises(RequestError):
        guarded(catalog.scan("t"), 8)
    assert guarded(catalog.scan("t"), 9).count() == 9


def test_batches(catalog):
    for size in (1, 4, 9, 20):
        got = [r.k for b in batches(Q("t").order_by("owner", "desc").ast, catalog, size) for r in b.collect()]
        assert got == [1, 3, 5, 7, 0, 2, 6, 8, 4]
    assert [r.k for b in batches(Q("t").limit(5).ast, catalog, 2) for r in b.collect()] == [0, 1, 2, 3, 4]


def test_desires(spark):
    d = spark.createDataFrame([("c", "q1"), ("c", "q2"), ("e", "q1")], "client string, query string")
    patch = spark.createDataFrame([(1, "c", "put", "q3"), (2, "c", "clear", None), (3, "c", "put", "q4"), (4, "e", "del", "q1"), (5, "e", "put", "q1"), (6, "e", "del", "q9")], "seq int, client string, op string, query string")
    after = desires.apply_patch(d, patch)
    assert {tuple(r) for r in after.collect()} == {("c", "q4"), ("e", "q1")}
    assert [tuple(r) for r in desires.got_queries(d, after, "c").orderBy("op", "query").collect()] == [("del", "q1"), ("del", "q2"), ("put", "q4")]
    acks = spark.createDataFrame([("c", 5)], "client string, version long")
    assert desires.acknowledge(acks, spark.createDataFrame([("c", 3), ("e", 1)], acks.schema)).where("client = 'c'").first().version == 5
    assert desires.delete_clients(d, ["e"], "c").count() == 2
    for bad in (["c"], [str(i) for i in range(65)]):
        with pytest.raises(RequestError):
            desires.delete_clients(d, bad, "c")
    owned = spark.createDataFrame([("t", "1", 1, "u"), ("t", "1", 2, "v"), ("t", "2", 1, "u"), ("t", "3", 0, "u")], "row_table string, row_pk string, refs long, owner string")
    assert [r.row_pk for r in desires.owners_match(owned, "u").collect()] == ["2"]
    base = spark.createDataFrame([("a", 2), ("b", 1)], "g string, n long")
    pending = spark.createDataFrame([("a", 1), ("a", 1), ("z", 9)], "g string, n long")
    assert {tuple(r) for r in desires.overlay(base, pending, ["g"], ["n"]).collect()} == {("a", 4), ("b", 1)}


@pytest.mark.parametrize("bad", [{"column": "k", "mode": "replace"}, {"column": "none", "mode": "replace"}, {"column": "doc", "mode": "append"}, {"column": "doc", "mode": "replace"}, {"column": "owner", "mode": "merge"}, {"column": "owner", "mode": "append", "max_bytes": 0}])
def test_manifest(bad):
    fields.validate_manifest([{"table": "t", "column": "owner", "mode": "append", "max_bytes": 10}], Catalog(T))
    with pytest.raises(RequestError):
        fields.validate_manifest([{"table": "t", "max_bytes": 10, **bad}], Catalog(T))
