"""The queries over whole tables leave no row out; held against brute force on the small tables."""

import os
from collections import Counter, defaultdict

import pytest

from karstflow.queries import QUERIES, catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables(spark):
    c = catalog(spark, FOLDER)
    return {t: c.scan(t).collect() for t in ("orders", "lineitem", "part")}


def rows(spark, name):
    return [tuple(r) for r in QUERIES[name](spark, FOLDER).collect()]


def test_order(spark, tables):
    want = sorted(((r.o_orderkey, r.due) for r in tables["orders"]), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert want[-1][1] is None and rows(spark, "order_null_desc") == want


def test_lists(spark, tables):
    n = Counter(r.l_orderkey for r in tables["lineitem"])
    assert sorted(rows(spark, "related_empty_list")) == sorted((r.o_orderkey, n[r.o_orderkey]) for r in tables["orders"])


def test_junction(spark, tables):
    size, of = {r.p_partkey: r.p_size for r in tables["part"]}, defaultdict(list)
    for r in tables["lineitem"]:
        if size.get(r.l_partkey, 0) > 10:
            of[r.l_orderkey].append((-size[r.l_partkey], r.l_partkey))
    want = [(r.o_orderkey, i + 1, -x[0]) for r in tables["orders"] for i, x in enumerate(sorted(of[r.o_orderkey])[:2])]
    assert sorted(rows(spark, "related_junction")) == sorted(want)


def test_visibility(spark, tables):
    effects, reads = defaultdict(set), defaultdict(dict)
    for r in tables["orders"]:
        effects[r.o_custkey].add(r.o_orderkey)
    for r in tables["lineitem"]:
        read = reads[r.l_suppkey % 5]
        read[r.l_orderkey] = read.get(r.l_orderkey, False) or r.l_quantity > 25
    want = {(g, n, sum(read[k] for k in keys), len(keys)) for g, keys in effects.items() for n, read in reads.items() if keys <= read.keys() and 0 < sum(read[k] for k in keys) < len(keys)}
    got = QUERIES["atomic_visibility"](spark, FOLDER).select("g", "read", "seen", "effects").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
