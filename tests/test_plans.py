"""The physical plans are the intended ones: filters and columns reach the scan, EXISTS is a semi join, ranks are limited early."""

import os
import re

import pytest

from karstflow.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name, want", [
    ("cmp_range", r"PushedFilters: .*GreaterThanOrEqual\(c_acctbal,1000"), ("cmp_range", r"ReadSchema: struct<c_custkey:bigint,c_acctbal:double>"), ("in_list", r"PushedFilters: .*In\(p_size"),
    ("exists_semi", "LeftSemi"), ("not_exists_anti", "LeftAnti"), ("exists_two_hop", "LeftSemi"), ("related_top_n", "WindowGroupLimit"), ("related_junction", "WindowGroupLimit"),
    ("related_nested", r"(?s)Window.*LeftSemi.*LeftSemi"),
    ("limit_topk", "TakeOrderedAndProject"), ("literal_left_deny", "LocalTableScan <empty>|EmptyRelation|LocalTableScan"), ("exists_limit0", r"PushedFilters: .*LessThan\(c_acctbal,0"),
])
def test_plan(spark, name, want):
    assert re.search(want, plan(spark, name)), plan(spark, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    assert not re.search(r"EvalPython|MapInPandas|MapInArrow|CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))
