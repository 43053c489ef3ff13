"""Semantics on small tables: nulls, cursors, nested objects, membership, change capture, streams."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from karstflow.functions import exprs, values
from karstflow.operators import aggregates, budget, cdc, desires, history, membership, mutations
from karstflow.plans import registry
from karstflow.plans.ast import Q, and_, cmp, exists, or_
from karstflow.plans.catalog import Catalog, RequestError, TableSpec, raw_sql
from karstflow.plans.planner import all_rows, closure, flat, nested
from karstflow.sources import readers, sinks
from karstflow.streaming import fields, ingest

BOOK = TableSpec("book", {"id": "string", "title": "string", "lent": "boolean", "pages": "number", "shelf": "string"}, ("id",))
NOTE = TableSpec("note", {"id": "string", "bookId": "string", "text": "string"}, ("id",))
TAG = TableSpec("tag", {"id": "string", "name": "string"}, ("id",))
LINK = TableSpec("link", {"bookId": "string", "tagId": "string", "n": "number"}, ("bookId", "tagId", "n"))
NOTES = ("note", "id", "bookId")
ALL = [f"b0{i}" for i in range(1, 8)]


@pytest.fixture(scope="module")
def catalog(spark):
    books = [("b01", "River maps", True, 120.0, "s3"), ("b02", "Oak", False, 300.0, "s1"), ("b03", "Ärger", None, 120.0, "s3"), ("b04", "100%_sure\\", False, None, "s2"),
             ("b05", "owl", True, 88.0, None), ("b06", "Quiet hills", None, None, "s1"), ("b07", "Moss", False, 45.0, "s4")]
    return Catalog(BOOK, NOTE, TAG, LINK).bind(
        book=spark.createDataFrame(books, "id string, title string, lent boolean, pages double, shelf string"),
        note=spark.createDataFrame([("n1", "b02", "dry"), ("n2", "b05", "wet"), ("n3", "b05", "dry"), ("n4", None, "lost"), ("n5", "b07", "wet")], "id string, bookId string, text string"),
        tag=spark.createDataFrame([("t1", "amber"), ("t2", "slate")], "id string, name string"),
        link=spark.createDataFrame([("b05", "t1", 1.0), ("b05", "t2", 1.0), ("b05", "t1", 2.0), ("b01", "t2", 1.0)], "bookId string, tagId string, n double"),
    )


def ids(catalog, q):
    return [r.id for r in flat(q.ast, catalog).collect()]


def found(catalog, *where):
    return sorted(ids(catalog, Q("book").where(*where)))


@pytest.mark.parametrize("where, want", [
    (("lent", "!=", True), "2 4 7"), (("lent", "IS NOT", True), "2 3 4 6 7"), (("pages", "=", None), ""), (("pages", "IS", None), "4 6"),
    (("pages", "IN", []), ""), (("pages", "NOT IN", []), "1 2 3 4 5 6 7"), (("pages", "IN", [120, None]), "1 3"), (("pages", "NOT IN", [120, None]), ""), (("pages", "NOT IN", [120]), "2 5 7"),
    (("pages", "=", "120"), "1 3"), (("pages", "=", "x"), ""), (("pages", "!=", "x"), "1 2 3 5 7"), (("pages", "<", "x"), "1 2 3 5 7"), (("pages", ">=", 88), "1 2 3 5"),
    (("lent", "=", 1), "1 5"), (("lent", "IN", [0]), "2 4 7"), (("title", "=", 5), ""), (("title", ">", "Quiet"), "1 3 5 6"),
    (("title", "LIKE", "o%"), "5"), (("title", "ILIKE", "o%"), "2 5"), (("title", "ILIKE", "ä%"), ""), (("title", "LIKE", "Ä%"), "3"), (("title", "LIKE", r"100\%\_sure\\"), "4"), (("title", "LIKE", r"\O\ak"), "2"),
    (("title", "NOT LIKE", "%s"), "2 3 4 5"), (("title", "LIKE", "_w_"), "5"),
    ((True,), "1 2 3 4 5 6 7"), ((False,), ""), ((and_(),), "1 2 3 4 5 6 7"), ((or_(),), ""),
    ((exists(NOTES),), "2 5 7"), ((exists(NOTES, negated=True),), "1 3 4 6"), ((or_(cmp("pages", "=", 120), exists(NOTES, Q("note").where("text", "dry"))),), "1 2 3 5"),
    ((or_(cmp("id", "=", "b02"), exists(NOTES, negated=True)),), "1 2 3 4 6"), ((exists(NOTES, Q("note").limit(0)),), ""), ((exists(NOTES, Q("note").limit(0), negated=True),), "1 2 3 4 5 6 7"),
    ((exists(("book", "shelf", "shelf"), Q("book").where("lent", True)),), "1 3"), ((exists(("link", "id", "bookId"), Q("link").where_exists(("tag", "tagId", "id"), Q("tag").where("name", "amber"))),), "5"),
])
def test_conditions(catalog, where, want):
    assert found(catalog, *where) == [f"b0{i}" for i in want.split()]


def test_trailing_backslash(catalog):
    with pytest.raises(RequestError):
        found(catalog, "title", "LIKE", "a\\")


def test_null_cursors_and_orders(catalog):
    assert ids(catalog, Q("book").order_by("pages").start({"pages": None, "id": "b04"})) == ["b06", "b07", "b05", "b01", "b03", "b02"]
    assert ids(catalog, Q("book").order_by("pages", "desc").start({"pages": 120, "id": "b01"})) == ["b03", "b05", "b07", "b04", "b06"]
    assert ids(catalog, Q("book").order_by("pages").limit(3)) == ["b04", "b06", "b07"]
    assert ids(catalog, Q("book").limit(2)) == ["b01", "b02"]
    with pytest.raises(RequestError):
        ids(catalog, Q("book").order_by("pages").start({"pages": 1}))


def test_pages_join_to_the_whole(catalog):
    whole = ids(catalog, Q("book").order_by("pages", "desc"))
    rows = flat(Q("book").order_by("pages", "desc").ast, catalog).collect()
    for size in (1, 2, 4):
        out, last = [], None
        while True:
            q = Q("book").order_by("pages", "desc").limit(size)
            part = flat((q if last is None else q.start({"pages": last.pages, "id": last.id})).ast, catalog).collect()
            out += [r.id for r in part]
            if len(part) < size:
                break
            last = part[-1]
        assert out == whole
    assert len(rows) == 7


def test_metamorphic(catalog):
    """Random condition trees: a redundant conjunct, another order, De Morgan with nulls, and prefixes by limit."""
    rng = random.Random(5)
    leaf = lambda: rng.choice([cmp("pages", rng.choice(["=", "!=", "<", ">=", "IS", "IS NOT"]), rng.choice([45, 88, 120, None])), cmp("lent", "=", rng.choice([True, False])), cmp("shelf", "IN", ["s1", "s3"]), exists(NOTES)])
    tree = lambda d: leaf() if d == 0 else rng.choice([and_, or_])(*(tree(d - 1) for _ in range(rng.randint(1, 3))))
    for _ in range(8):
        c = tree(2)
        base = found(catalog, c)
        assert found(catalog, and_(c, or_(c, leaf()))) == base
        if not hasattr(c, "op") and hasattr(c, "conditions"):
            assert found(catalog, type(c)(c.kind, tuple(reversed(c.conditions)))) == base
        q = Q("book").where(c).order_by("pages")
        assert ids(catalog, q.limit(2)) == ids(catalog, q)[:2]
        assert set(base) <= set(found(catalog, True))


def test_related_flat(catalog):
    q = Q("book").where("pages", ">", 50).related("notes", NOTES, Q("note").order_by("id", "desc").limit(1))
    (_, roots), (path, rows) = all_rows(q.ast, catalog)
    assert path == "book/notes" and sorted(r.id for r in rows.collect()) == ["n1", "n3"] and roots.count() == 4


@pytest.mark.parametrize("pages", [None, 80])
def test_nested(catalog, pages):
    """Whole parents, and parents that narrow what is ranked and packed beneath them, give the same objects."""
    tags = Q("link").related("tags", ("tag", "tagId", "id"), Q("tag").order_by("name"))
    q = Q("book").where("pages", ">", pages) if pages else Q("book")
    q = q.related("notes", NOTES, Q("note").related("book", ("book", "bookId", "id"))).related("l", ("link", "id", "bookId"), tags, hidden=True)
    rows = {r.id: r.asDict(True) for r in nested(q.ast, catalog, singles=frozenset({"notes.book"})).collect()}
    assert sorted(rows) == (ALL if pages is None else ["b01", "b02", "b03", "b05"])
    assert [n["id"] for n in rows["b05"]["notes"]] == ["n2", "n3"] and rows["b05"]["notes"][0]["book"]["title"] == "owl"
    assert [x["name"] for x in rows["b05"]["tags"]] == ["amber", "amber", "slate"]  # a repeated junction row repeats its target
    assert rows["b03"]["notes"] == [] and rows["b03"]["tags"] == [] and [x["name"] for x in rows["b01"]["tags"]] == ["slate"]
    one = nested(Q("book").related("notes", NOTES).ast, catalog, singles=frozenset({"notes"})).collect()
    assert {r.id: r.notes and r.notes.id for r in one} == {**dict.fromkeys(ALL), "b02": "n1", "b05": "n2", "b07": "n5"}
    none = nested(Q("book").related("notes", NOTES, Q("note").limit(0)).ast, catalog, singles=frozenset({"notes"})).collect()
    assert [r.notes for r in none] == [None] * 7


def test_closure(catalog):
    rows = closure(Q("book").where(or_(cmp("id", "=", "b01"), exists(NOTES, Q("note").where("text", "dry")))).ast, catalog).collect()
    assert sorted((r.row_table, json.loads(r.row_pk)["id"]) for r in rows) == [("book", "b01"), ("book", "b02"), ("book", "b05"), ("note", "n1"), ("note", "n3")]
    assert closure(Q("book").where(exists(NOTES, negated=True)).ast, catalog).where("row_table = 'note'").count() == 0


def test_membership_follows_changes(spark, catalog):
    """The patched store equals a fresh evaluation after each random change."""
    rng = random.Random(3)
    queries = {"here": Q("book").where("lent", False).ast, "noted": Q("book").where_exists(NOTES).related("notes", NOTES).ast}
    rows = [r.asDict() for r in catalog.scan("book").collect()]
    durable = membership.members(queries, catalog)
    refs = durable.groupBy(*membership.KEY).agg(F.count("*").alias("refs")).withColumns({"added": F.lit(1).cast("long"), "removed": F.lit(None).cast("long")})
    store = {tuple(r) for r in durable.select(*membership.KEY).distinct().collect()}
    for version in (2, 3):
        for r in rng.sample(rows, 3):
            r["lent"] = rng.choice([True, False])
        now = catalog.bind(book=spark.createDataFrame(rows, catalog.scan("book").schema))
        live = membership.members(queries, now)
        diff = membership.membership_diff(live, durable)
        moved = membership.apply_delta(refs, membership.net_delta(diff), version)
        for r in membership.row_patch(moved, diff.limit(0), live).collect():
            (store.add if r.op == "put" else store.discard)((r.row_table, r.row_pk))
        assert store == {tuple(r) for r in live.select(*membership.KEY).distinct().collect()}
        assert {(r.op, r.row_pk) for r in membership.replay(moved, version - 1).collect()} == {(r.op, r.row_pk) for r in moved.where("op IS NOT NULL").collect()}
        durable, refs = spark.createDataFrame(live.collect(), live.schema), spark.createDataFrame(moved.drop("op").collect(), moved.drop("op").schema)
    assert membership.prune(refs, 3).where("refs <= 0").count() == 0
    value = membership.with_values(membership.full_patch(durable).select("op", *membership.KEY), "book", catalog).where("id like '%b02%'").first()
    assert json.loads(value.value)["title"] == "Oak"


def test_membership_control():
    q = {"a": Q("book").where_exists(NOTES).ast, "b": Q("tag").ast}
    assert set(membership.touched_queries(q, {"note"}, {"a", "b"})) == {"a"} and set(membership.touched_queries(q, set(), {"a"})) == {"b"}
    assert [membership.response_mode(*x) for x in ((None, 0, 5), (1, 2, 5), (5, 0, 5), (4, 0, 5), (5, 0, 5, True))] == ["full", "full", "unchanged", "diff", "full"]
    with pytest.raises(RequestError):
        membership.response_mode(6, 0, 5)


def test_overlay_and_budgets(spark, catalog):
    base = spark.createDataFrame([("a", 2, 1.0)], "g string, n long, t double")
    pending = lambda *rows: spark.createDataFrame(rows, "g string, n long, t double")
    assert [tuple(r) for r in desires.overlay(base, pending(("a", 1, -0.5), ("z", 1, 1.0)), ["g"], ["n", "t"]).collect()] == [("a", 3, 0.5)]
    for bad in ((None, 1, 1.0), ("a", 1, float("nan")), ("a", 1, float("inf")), ("a", None, 1.0)):
        with pytest.raises(RequestError):
            desires.overlay(base, pending(bad), ["g"], ["n", "t"])
    q = Q("book").related("notes", NOTES).ast
    assert [p for p, _ in registry.within_budget(q, catalog, 8, 11)] == ["book", "book/notes"]
    for limits in ((7, 11), (8, 10)):
        with pytest.raises(RequestError):
            registry.within_budget(q, catalog, *limits)


def test_aggregate_deltas(spark):
    d = aggregates.Aggregate("s", "t", {"g": "key"}, "n", {"total": "x"})
    before = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, "b", 5), (4, None, 1)], "id int, g string, x long")
    after = spark.createDataFrame([(1, "b", 2), (2, "a", 7), (4, None, 3), (5, "c", 1)], "id int, g string, x long")
    changes = cdc.capture(before, after, ["id"])
    got = aggregates.merge(aggregates.full(before, d), aggregates.delta(changes, d), d)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, aggregates.full(after, d).collect()), key=str)
    parents = spark.createDataFrame([("a",), ("z",)], "key string")
    e = aggregates.Aggregate("s", "t", {"g": "key"}, "n", {"total": "x"}, target="parents")
    start = aggregates.backfill_existing(parents, before, e)
    assert {tuple(r) for r in start.collect()} == {("a", 2, 2), ("z", 0, 0)}
    assert {tuple(r) for r in aggregates.merge_existing(start, aggregates.delta(changes, e), e).collect()} == {("a", 1, 7), ("z", 0, 0)}
    ranks = aggregates.nearest_rank(spark.range(1, 11).withColumnRenamed("id", "v"), "v", [0, 50, 99, 100])
    assert {r.p: r.value for r in ranks.collect()} == {0.0: 1, 50.0: 6, 99.0: 10, 100.0: 10}
    rng, rows = random.Random(7), []
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 9)) for _ in range(200)] + [("a", None)]
    got = aggregates.nearest_rank(spark.createDataFrame(rows, "g string, v int"), "v", [1, 50, 90], ["g"]).collect()
    of = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    assert {(r.g, r.p): r.value for r in got} == {(g, float(p)): v[min(len(v) * p // 100, len(v) - 1)] for g, v in of.items() for p in (1, 50, 90)}


def test_cdc(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    row = "struct<k:int,v:string>"
    log = spark.createDataFrame([(1, "UPDATE", (1, "a"), (9, "a2")), (2, "DELETE", (2, "b"), None), (3, "INSERT", None, (2, "b2")), (4, "INSERT", None, (4, "d")), (5, "DELETE", (4, "d"), None)], f"watermark long, op string, old {row}, new {row}")
    assert sorted(map(tuple, cdc.apply(t, log, ["k"]).collect())) == [(2, "b2"), (3, "c"), (9, "a2")]
    assert sorted(map(tuple, cdc.apply(t, log, ["k"], 3).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(r.k for r in cdc.touched(log, ["k"]).collect()) == [1, 2, 4, 9]
    merged = {r.k: (r.old and r.old.v, r.new and r.new.v) for r in cdc.coalesce_changes(log.select("watermark", F.coalesce("new.k", "old.k").alias("k"), "old", "new"), ["k"]).collect()}
    assert merged[4] == (None, None) and merged[2] == ("b", "b2")
    with pytest.raises(RequestError):
        cdc.apply(t.withColumn("w", F.lit(1)), log, ["k"])
    with pytest.raises(RequestError):
        cdc.apply(t.select("k"), log, ["k"])
    with pytest.raises(RequestError):
        cdc.check_watermarks(log.union(log))
    stage = cdc.StagedSnapshot({"t": ["k"]}, "s1")
    stage.add("t", t.limit(2), "s1", 3, False)
    with pytest.raises(RequestError):
        stage.finish({})
    stage.add("t", t.where("k = 3"), "s1", 4, True)
    assert sorted(r.k for r in stage.finish({"t": log})["t"].collect()) == [1, 2, 3]
    ledger = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (4, "t", "b")], "version long, row_table string, row_pk string")
    assert [r.version for r in cdc.ledger_gaps(ledger, 0).collect()] == [4] and cdc.ledger_scan(ledger, 1).count() == 1
    assert cdc.retain(ledger, 4, 2)[0].count() == 1
    writes = spark.createDataFrame([(8, "t", "b"), (3, "t", "a"), (8, "t", "b"), (8, "t", "a")], "txn int, row_table string, row_pk string")
    start = ledger.withColumn("segment", F.lit(0).cast("long"))
    assert sorted(map(tuple, cdc.ledger_append(start, writes, rotate=2).where("version > 4").collect())) == [(5, "t", "a", 1), (6, "t", "a", 2), (6, "t", "b", 2)]
    assert sorted(r.version for r in cdc.ledger_append(start.limit(0), writes).collect()) == [1, 2, 2]
    with pytest.raises(RequestError):
        cdc.ledger_append(start, writes, most=3)
    marked, floor = cdc.invalidate(start)
    assert floor == 5 and marked.count() == 4 and cdc.ledger_scan(marked, 4).count() == 0


def test_mutations(spark):
    spec = TableSpec("t", {"k": "number", "a": "string", "b": "string"}, ("k",))
    t = spark.createDataFrame([(1, "x", "y"), (2, "p", "q")], "k int, a string, b string")
    rows = spark.createDataFrame([(2, None), (3, "n")], "k int, a string")
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(mutations.upsert(t, rows, spec)) == [(1, "x", "y"), (2, None, "q"), (3, "n", None)]
    assert get(mutations.update(t, rows, spec)) == [(1, "x", "y"), (2, None, "q")]
    assert get(mutations.insert(t, rows, spec)) == [(1, "x", "y"), (2, "p", "q"), (3, "n", None)]
    assert get(mutations.delete(t, rows, spec)) == [(1, "x", "y")]
    with pytest.raises(RequestError):
        mutations.update(t, rows.withColumn("z", F.lit(1)), spec)
    assert {tuple(r) for r in mutations.check_write_set(t, rows, ["k"]).collect()} == {(1, "undeclared"), (3, "unwritten")}
    pushes = spark.createDataFrame([("c", 1, "u"), ("c", 2, "u"), ("c", 4, "u"), ("d", 1, "u"), ("e", 9, "v")], "client string, id long, user string")
    clients = spark.createDataFrame([("c", 1, "u"), ("e", 8, "u")], "client string, last_id long, user string")
    assert {(r.client, r.id, r.verdict) for r in mutations.preflight(pushes, clients).collect()} == {("c", 1, "replay"), ("c", 2, "apply"), ("c", 4, "gap"), ("d", 1, "apply"), ("e", 9, "forbidden")}
    twice = spark.createDataFrame([(2, "m", 1), (2, "n", 2), (5, "b", 9), (5, "a", 8)], "k int, a string, at int")
    assert get(mutations.upsert(t, twice, spec, "at")) == [(1, "x", "y"), (2, "n", "q"), (5, "b", None)]
    assert get(mutations.insert(t, twice, spec, "at")) == [(1, "x", "y"), (2, "p", "q"), (5, "a", None)]
    assert get(mutations.update(t, twice.drop("at"), spec)) == [(1, "x", "y"), (2, "n", "q")]
    sent = spark.createDataFrame([(1, "c", 2), (2, "c", 9)], "seq long, client string, id long")
    assert {tuple(r) for r in mutations.settle_in_order(sent, sent, clients).collect()} == {("c", 9), ("e", 8)}
    for other in (sent.where("seq = 1"), sent.withColumn("seq", 3 - F.col("seq"))):
        with pytest.raises(RequestError):
            mutations.settle_in_order(sent, other, clients)
    bodies = spark.createDataFrame([(1, 1, "c", 1, "a"), (1, 1, "c", 2, "tidy"), (2, 2, "c", 1, "a"), (3, 1, "c", 1, "a"), (3, 1, "c", 1, "b"), (4, 1, None, 1, "a"), (5, None, "c", 1, "a")], "push int, version int, client string, id long, name string")
    good, problems = mutations.check_pushes(bodies, ("tidy",))
    assert get(good) == [(1, "c", 1, "a")] and get(problems) == [(2, "unsupported version"), (3, "repeated id"), (4, "malformed mutation"), (5, "unsupported version")]
    acks = spark.createDataFrame([("c", 7), ("e", 3)], "client string, id long")
    assert {tuple(r) for r in mutations.settle_acks(acks, clients).collect()} == {("c", 7), ("e", 8)}


def test_values(spark):
    cases = {"17.25": 17.25, "-3e2": -300.0, " 17.25": None, "x": None, "1970-01-01 00:00:01": 1000.0, "1970-01-01T00:00:01.5Z": 1500.0, "1970-01-01T01:00:00+01": 0.0, "1970-01-01 01:00:00+0100": 0.0, "1970-01-01T01:00:00.1239+01:00": 123.0, "1970-01-01": None, "1970-13-01 00:00:00": None, "1970-01-01T00:00:00+0": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.v for r in df.select("t", values.text_to_number(F.col("t")).alias("v")).collect()} == cases
    b = spark.createDataFrame([("1",), ("t",), ("no",), (None,)], "t string").select(values.loose_boolean(F.col("t")).alias("b")).collect()
    assert [r.b for r in b] == [True, True, False, None]
    j = spark.createDataFrame([('{"b": 1, "a": [2]}',), ("not json",)], "t string").select(values.canonical_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in j] == ['{"a":[2],"b":1}', "not json"]
    n = spark.createDataFrame([(2.0,), (2.5,), (float("nan"),), (float("inf"),)], "x double").select(values.json_number(F.col("x")).alias("n")).collect()
    assert [r.n for r in n] == ["2", "2.5", None, None]
    assert exprs.like_pattern(r"\a\%\\") == r"a\%" + "\\\\"
    with pytest.raises(Exception):
        spark.createDataFrame([("maybe",)], "t string").select(values.strict_boolean(F.col("t"))).collect()


def test_sources_and_sinks(spark, catalog, tmp_path):
    out, after = [], None
    for part in readers.pages(catalog, "book", 4):
        out += [r.id for r in part.collect()]
    assert out == ALL
    odd = ["a\\\\nb", "\x01", "x\\ty\\\\", "\\q\\\\\\n", "", "\\N", "\\\\N", "end\\"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string").select("i", readers.unescape(F.col("x")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == ["a\\nb", "\x01", "x\ty\\", "q\\\n", "", None, "\\N", "end\\"]
    dump = tmp_path / "dump.sql"
    dump.write_text("SET x;\nCOPY public.t (a, \"b\") FROM stdin;\n1\tx\\ty\\\\n\n2\t\\N\n\\.\n\nCOPY u (c) FROM stdin;\nz\n\\.\n")
    tables = readers.copy_blocks(spark, str(dump))
    assert sorted(map(tuple, tables["t"].collect()), key=str) == [("1", "x\ty\\n"), ("2", None)] and [r.c for r in tables["u"].collect()] == ["z"]
    sinks.backup(catalog, str(tmp_path / "b"))
    assert sorted(map(tuple, sinks.restore(spark, str(tmp_path / "b"))["tag"].collect())) == [("t1", "amber"), ("t2", "slate")]
    logs = spark.createDataFrame([(i, "a" if i % 2 else "b", i % 4, "m") for i in range(10)], "id long, source string, priority int, message string")
    assert [r.id for r in readers.log_entries(logs, "a", 1, 2, 2).collect()] == [9, 5]
    assert raw_sql(spark, catalog, "-- c\nSELECT count(*) AS n FROM book").first().n == 7
    with pytest.raises(RequestError):
        raw_sql(spark, catalog, "DROP TABLE book")


def test_history(spark):
    good = [(0, 1, "p", "invoke", "r"), (1, 2, "p", "ok", "r"), (2, 2, "q", "invoke", "w"), (3, 3, "q", "info", "w")]
    bad = [(0, 5, "p", "invoke", "r"), (1, 4, "p", "invoke", "r"), (3, 6, "q", "ok", "w")]
    schema = "index long, time long, process string, type string, kind string"
    assert history.validate(spark.createDataFrame(good, schema)).count() == 0
    assert {r.problem for r in history.validate(spark.createDataFrame(bad, schema)).collect()} == {"time goes back", "gap in indexes", "invoke while another is open", "end without an invoke", "invoke without an end"}
    pushes = spark.createDataFrame([("c", 1, True, True), ("c", 2, False, True), ("d", 1, True, True), ("d", 1, True, True)], "client string, id long, applied boolean, acked boolean")
    finals = spark.createDataFrame([("c", 2), ("d", 1)], "client string, last_id long")
    assert {tuple(r) for r in history.exactly_once(pushes, finals).collect()} == {("c", "acknowledged and not applied"), ("c", "last id differs"), ("d", "applied twice")}
    reads = spark.createDataFrame([("c", "k", 1), ("c", "k", 5)], "client string, key string, version long")
    grants = spark.createDataFrame([("c", "k", 0, 3)], "client string, key string, since long, until long")
    assert [r.version for r in history.permission_leaks(reads, grants).collect()] == [5]


def test_history_is_checked_in_small_tasks(spark, monkeypatch):
    """However long the history, a task takes some ``ROWS`` events; odd histories give the problems that brute force finds."""
    monkeypatch.setattr(history, "ROWS", 50, raising=False)
    rng = random.Random(5)
    # gaps, repeated indexes (never of one process) and falling times
    events = [(i, i * 10 + rng.choice([0, 0, 25]), f"p{copy}{rng.randrange(6)}", rng.choice(["invoke", "ok", "fail"]), rng.choice("ab")) for i in range(1000) if i % 97 for copy in range(1 + (i % 50 == 3))]
    df = spark.createDataFrame(events, "index long, time long, process string, type string, kind string")
    want, seen, last = Counter(), defaultdict(list), {}
    for i, t, *_ in events:
        seen[i].append(t)
    for i, times in seen.items():
        want[i, "index repeats"] += len(times) > 1
        want[i, "gap in indexes"] += len(times) * (i != 0 and i - 1 not in seen)
        want[i, "time goes back"] += sum(t < b for t in times for b in seen.get(i - 1, []))
    for i, _, p, kind_of, kind in events:
        was = last.get(p)
        if kind_of == "invoke":
            want[i, "invoke while another is open"] += was is not None and was[1] == "invoke"
        else:
            want[i, "end without an invoke" if was is None or was[1] != "invoke" else "end of another kind"] += was is None or was[1] != "invoke" or was[2] != kind
        if was is not None and was[1] == "invoke" and kind_of == "invoke":
            want[was[0], "invoke without an end"] += 1
        last[p] = (i, kind_of, kind)
    for i, kind_of, _ in last.values():
        want[i, "invoke without an end"] += kind_of == "invoke"
    found = history.validate(df)
    assert Counter(tuple(r) for r in found.collect()) == +want
    assert found.rdd.getNumPartitions() >= 3 * len(events) // 50


def test_windows(spark):
    e = spark.createDataFrame([("a", 0, 5.0), ("a", 1500, 5.0), ("a", 9000, 1.0), ("b", 0, 1.0)], "g string, ms long, x double")
    rolling = budget.rolling_sum(e, ["g"], "ms", "x", 3000)
    assert {(r.g, r.bucket): r.rolling for r in rolling.collect()} == {("a", 0): 5.0, ("a", 1): 10.0, ("a", 9): 1.0, ("b", 0): 1.0}
    assert [(r.g, r.bucket) for r in budget.tripped(rolling, ["g"], 6).collect()] == [("a", 1)]
    assert [r.pause_ms for r in budget.breaker(rolling, ["g"], 4, 100, 150).orderBy("bucket").collect()] == [100, 150]
    commits = spark.createDataFrame([("g", 1, 10), ("g", 2, 20), ("g", 5, 30)], "group string, version long, at long")
    serves = spark.createDataFrame([("g", 2, 15), ("g", 4, 40)], "group string, version long, at long")
    assert {r.version: (r.lag, r.clamped) for r in budget.serving_lag(commits, serves).collect()} == {1: (5, False), 2: (0, True), 5: (None, None)}
    files = spark.createDataFrame([("a", "s", 1, 10), ("b", "s", 90, 10), ("c", "s", 95, 10)], "name string, shard string, used_at long, bytes long")
    assert {tuple(r) for r in budget.retention_plan(files, 100, 50, 15).collect()} == {("a", "age"), ("b", "bytes")}


def test_fields(spark, tmp_path):
    rows = [("t", "s1", 1, 0, "append", "old", False), ("t", "s2", 2, 1, "append", "b", False), ("t", "s2", 2, 0, "append", "a", False), ("t", "s2", 2, 1, "append", "b", True), ("u", "s", 1, 0, "replace", "x", False), ("u", "s", 1, 1, "replace", "y", False)]
    frames = spark.createDataFrame(rows, "topic string, stream string, started long, seq long, mode string, value string, ended boolean")
    assert {(r.topic, r.stream, r.value, r.seq) for r in fields.accumulate(frames).collect()} == {("t", "s2", "ab", 1), ("u", "s", "y", 1)}
    grown = spark.createDataFrame([("t", 0, "ab"), ("t", 1, "abc"), ("t", 2, "x")], "topic string, seq long, value string")
    assert [(r.suffix, r.broken) for r in fields.suffixes(grown).orderBy("seq").collect()] == [("ab", False), ("c", False), (None, True)]
    source = tmp_path / "frames"
    frames.where("topic = 't'").coalesce(1).write.parquet(str(source))
    q = fields.live_fields(spark.readStream.schema(frames.schema).parquet(str(source))).writeStream.format("memory").queryName("live").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live").collect()
    assert [(r.stream, r.value, r.rejected) for r in got] == [("s2", "ab", 1)]


@pytest.mark.parametrize("frames_in_one", [2, 10_000])
def test_live_fields_in_any_order(spark, tmp_path, frames_in_one):
    """Rows that reach the fold in many chunks, and in falling order, are all kept; without a bound so are long values."""
    rows = [("t", "s2", 2, i, "append", f"{i};", False) for i in range(40)] + [("t", "s1", 1, i, "append", "old", False) for i in range(9)] + [("u", "s", 1, i, "append", "x" * 300_000, False) for i in range(5)]
    frames = spark.createDataFrame(rows[::-1], "topic string, stream string, started long, seq long, mode string, value string, ended boolean")
    frames.coalesce(1).write.parquet(str(tmp_path / "frames"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, frames_in_one)
    try:
        live = fields.live_fields(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames")), max_bytes=None)
        name = f"live_{frames_in_one}"
        live.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(key, before)
    got = {(r.topic, r.stream, r.seq, r.rejected): r.value for r in spark.table(name).collect()}
    assert got == {("t", "s2", 39, 0): "".join(f"{i};" for i in range(40)), ("u", "s", 4, 0): "x" * 1_500_000}


def test_stream_ingest(spark, tmp_path):
    """Applying a stream batch by batch, and again after a restart, gives what one batch gives."""
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    row = "struct<k:int,v:string>"
    schema = f"watermark long, op string, old {row}, new {row}"
    log = [(1, "UPDATE", (1, "a"), (1, "a2")), (2, "INSERT", None, (3, "c")), (3, "DELETE", (2, "b"), None), (4, "UPDATE", (3, "c"), (4, "d"))]
    table = ingest.VersionedTable(spark, str(tmp_path / "t"), t.schema, ["k"])
    table.create(t)
    for part in (log[:2], log[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(spark.createDataFrame(log, schema).schema).parquet(str(tmp_path / "log"))
        ingest.ingest(stream, table, str(tmp_path / "cp")).awaitTermination(120)
    table.apply(spark.createDataFrame(log, schema))
    written = table.log().count()
    assert table.log().where("version > 0").groupBy("version").count().where("count > 3").isEmpty() and table.purge() > 0 and table.log().count() == written
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, cdc.apply(t, spark.createDataFrame(log, schema), ["k"]).collect())) == [(1, "a2"), (4, "d")]
