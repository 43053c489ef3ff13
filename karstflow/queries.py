"""The registered queries of the live-query engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .operators import aggregates, budget, cdc, history, membership, mutations
from .plans.ast import Q, and_, cmp, exists, or_, parse
from .plans.catalog import Catalog, TableSpec
from .plans.planner import all_rows, closure, flat, nested, probe
from .sources import readers
from .sources.shared import settle, shared_path
from .streaming import fields, ingest

N, S = "number", "string"
SPECS = (
    TableSpec("customer", {"c_custkey": N, "c_name": S, "c_nationkey": N, "c_acctbal": N, "c_mktsegment": S}, ("c_custkey",)),
    TableSpec("orders", {"o_orderkey": N, "o_custkey": N, "o_orderstatus": S, "o_totalprice": N, "o_orderpriority": S, "due": N}, ("o_orderkey",)),
    TableSpec("lineitem", {"l_orderkey": N, "l_partkey": N, "l_suppkey": N, "l_linenumber": N, "l_quantity": N, "l_extendedprice": N, "l_returnflag": S}, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")),
    TableSpec("nation", {"key": N, "name": S, "region": N}, ("key",), {"key": "n_nationkey", "name": "n_name", "region": "n_regionkey"}),
    TableSpec("region", {"r_regionkey": N, "r_name": S}, ("r_regionkey",)),
    TableSpec("supplier", {"s_suppkey": N, "s_name": S, "s_nationkey": N, "s_acctbal": N}, ("s_suppkey",)),
    TableSpec("part", {"p_partkey": N, "p_name": S, "p_brand": S, "p_type": S, "p_size": N}, ("p_partkey",)),
    TableSpec("events", {"event_id": N, "user_id": N, "event_type": S, "value": N, "props": "json"}, ("event_id",)),
)

CUSTOMER_ORDERS = ("orders", "c_custkey", "o_custkey")
ORDER_LINES = ("lineitem", "o_orderkey", "l_orderkey")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: orders with a column that has NULLs, in every statement that needs one
DUE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice / 1000) END AS due FROM orders"


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    out = Catalog(*SPECS).load(spark, sf_dir)
    due = F.when(F.col("o_orderstatus") != "P", F.round(F.col("o_totalprice") / 1000))
    return out.bind(orders=out.frames["orders"].withColumn("due", due))


def query(sql: str | None):
    """Register a query over (catalog, spark, sf_dir)."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def ask(name: str, sql: str, q: Q, *columns: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: flat(q.ast, catalog(spark, sf_dir)).select(*columns)
    SQL[name] = sql


# ---- scans and predicates ----

ask("scan_projection", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation", Q("nation"), "key", "name", "region")
ask("cmp_eq_ne_null", f"WITH o AS ({DUE}) SELECT o_orderkey, due FROM o WHERE due <> 100 AND o_orderstatus = 'O'", Q("orders").where("due", "!=", 100).where("o_orderstatus", "O"), "o_orderkey", "due")
ask("cmp_range", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 5000.5", Q("customer").where("c_acctbal", ">=", 1000).where("c_acctbal", "<", 5000.5), "c_custkey", "c_acctbal")
ask("cmp_text_literal_on_number", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000", Q("customer").where("c_acctbal", ">", "9000").where("c_acctbal", "<", "text"), "c_custkey")
ask("is_isnot_literal", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE due IS DISTINCT FROM 150 AND o_orderstatus IS NOT DISTINCT FROM 'P'", Q("orders").where("due", "IS NOT", 150).where("o_orderstatus", "IS", "P"), "o_orderkey")
ask("is_null", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE due IS NULL", Q("orders").where("due", "IS", None), "o_orderkey")
ask("in_list", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 20)", Q("part").where("p_size", "IN", [1, 7, 20]), "p_partkey", "p_size")
ask("in_notin_null", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE due IN (100, 150, NULL) OR due NOT IN (200, NULL)", Q("orders").where(or_(cmp("due", "IN", [100, 150, None]), cmp("due", "NOT IN", [200, None]))), "o_orderkey")
ask("not_in", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE due NOT IN (100, 150)", Q("orders").where("due", "NOT IN", [100, 150]), "o_orderkey")
ask("in_empty", "SELECT r_regionkey FROM region WHERE false OR true", Q("region").where(or_(cmp("r_name", "IN", []), cmp("r_name", "NOT IN", []))), "r_regionkey")
ask("like_case", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%1_' AND c_mktsegment NOT LIKE '%build%'", Q("customer").where("c_name", "LIKE", "Customer#%1_").where("c_mktsegment", "NOT LIKE", "%build%"), "c_custkey")
ask("like_escape", r"SELECT event_id FROM events WHERE props LIKE '{\"k\":%' ESCAPE '\'", Q("events").where("props", "LIKE", r'\{\"k\":%'), "event_id")
ask("ilike_ascii", "SELECT c_custkey FROM customer WHERE translate(c_mktsegment, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE 'bu%ing'", Q("customer").where("c_mktsegment", "ILIKE", "bU%InG"), "c_custkey")
ask("and_or_tree", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE (o_orderstatus = 'F' AND (due > 300 OR o_orderpriority = '1-URGENT')) OR o_totalprice < 2000", Q("orders").where(or_(and_(cmp("o_orderstatus", "=", "F"), or_(cmp("due", ">", 300), cmp("o_orderpriority", "=", "1-URGENT"))), cmp("o_totalprice", "<", 2000))), "o_orderkey")
ask("empty_junctions", "SELECT r_regionkey FROM region WHERE true", Q("region").where(or_(and_(), or_())), "r_regionkey")
ask("literal_left", "SELECT r_regionkey FROM region WHERE 0 = 0", Q("region").where(True), "r_regionkey")
ask("literal_left_deny", "SELECT r_regionkey FROM region WHERE 1 = 0", Q("region").where(False), "r_regionkey")

# ---- order, limit, cursors ----

ask("order_null_smallest", f"WITH o AS ({DUE}) SELECT o_orderkey, due FROM o ORDER BY due NULLS FIRST, o_orderkey LIMIT 50", Q("orders").order_by("due").limit(50), "o_orderkey", "due")
ask("order_null_desc", f"WITH o AS ({DUE}) SELECT o_orderkey, due FROM o ORDER BY due DESC NULLS LAST, o_orderkey", Q("orders").order_by("due", "desc"), "o_orderkey", "due")
ask("order_pk_tiebreak", "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 25", Q("customer").order_by("c_mktsegment", "desc").limit(25), "c_custkey", "c_mktsegment")
ask("limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", Q("orders").order_by("o_totalprice", "desc").limit(100), "o_orderkey", "o_totalprice")
ask("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0", Q("orders").limit(0), "o_orderkey")
ask("one_singular", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 1", Q("customer").where("c_nationkey", 3).one(), "c_custkey", "c_name")
ask("cursor_asc", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 OR (o_totalprice = 100000 AND o_orderkey > 5) ORDER BY o_totalprice, o_orderkey LIMIT 40", Q("orders").order_by("o_totalprice").start({"o_totalprice": 100000, "o_orderkey": 5}).limit(40), "o_orderkey", "o_totalprice")
ask("cursor_desc", f"WITH o AS ({DUE}) SELECT o_orderkey, due FROM o WHERE (due < 60 OR due IS NULL) OR (due = 60 AND o_orderkey > 100)", Q("orders").order_by("due", "desc").start({"due": 60, "o_orderkey": 100}), "o_orderkey", "due")
ask("cursor_null", f"WITH o AS ({DUE}) SELECT o_orderkey, due FROM o WHERE due IS NOT NULL OR (due IS NULL AND o_orderkey > 1000)", Q("orders").order_by("due").start({"due": None, "o_orderkey": 1000}), "o_orderkey", "due")
ask("cursor_null_desc", f"WITH o AS ({DUE}) SELECT o_orderkey FROM o WHERE due IS NULL AND o_orderkey >= 1000", Q("orders").order_by("due", "desc").start({"due": None, "o_orderkey": 1000}, inclusive=True), "o_orderkey")
ask("cursor_inclusive", "SELECT c_custkey FROM customer WHERE c_custkey >= 700", Q("customer").order_by("c_custkey").start({"c_custkey": 700}, inclusive=True), "c_custkey")
ask("cursor_multi_key", "SELECT o_orderkey FROM orders WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_totalprice > 200000) OR (o_orderstatus = 'O' AND o_totalprice = 200000 AND o_orderkey > 3)", Q("orders").order_by("o_orderstatus", "desc").order_by("o_totalprice").start({"o_orderstatus": "O", "o_totalprice": 200000, "o_orderkey": 3}), "o_orderkey")

# ---- EXISTS trees ----

ask("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", Q("customer").where_exists(CUSTOMER_ORDERS, Q("orders").where("o_totalprice", ">", 300000)), "c_custkey")
ask("exists_limit0", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM (SELECT * FROM orders LIMIT 0) o WHERE o_custkey = c_custkey) OR (c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM orders LIMIT 0) o WHERE o_custkey = c_custkey))", Q("customer").where(or_(exists(CUSTOMER_ORDERS, Q("orders").limit(0)), and_(cmp("c_acctbal", "<", 0), exists(CUSTOMER_ORDERS, Q("orders").limit(0), negated=True)))), "c_custkey")
ask("not_exists_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", Q("customer").where_exists(CUSTOMER_ORDERS, Q("orders").where("o_orderstatus", "P"), negated=True), "c_custkey")
ask("exists_under_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", Q("customer").where(or_(cmp("c_acctbal", "<", 0), exists(CUSTOMER_ORDERS, Q("orders").where("o_totalprice", ">", 400000)), exists(CUSTOMER_ORDERS, negated=True))), "c_custkey")
ask("exists_two_hop", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 50 AND l_returnflag = 'R'))", Q("customer").where_exists(CUSTOMER_ORDERS, Q("orders").where_exists(ORDER_LINES, Q("lineitem").where("l_quantity", ">=", 50).where("l_returnflag", "R"))), "c_custkey")
ask("permission_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND (o_orderstatus = 'O' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')) AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", Q("orders").where("o_totalprice", ">", 250000).where(and_(or_(cmp("o_orderstatus", "=", "O"), exists(("customer", "o_custkey", "c_custkey"), Q("customer").where("c_mktsegment", "BUILDING"))), exists(ORDER_LINES))), "o_orderkey")
ask("compound_correlation", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.l_returnflag = 'N' AND b.l_quantity > 45)", Q("lineitem").where_exists(("lineitem", ("l_orderkey", "l_linenumber"), ("l_orderkey", "l_linenumber")), Q("lineitem").where("l_returnflag", "N").where("l_quantity", ">", 45)), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

FLAGSHIP = Q("customer").where("c_mktsegment", "BUILDING").where_exists(CUSTOMER_ORDERS, Q("orders").where("o_orderstatus", "O")).order_by("c_acctbal", "desc").limit(20)
FLAGSHIP_SQL = "p AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') ORDER BY c_acctbal DESC, c_custkey LIMIT 20)"
RANKED_SQL = "r AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rn FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM p))"
TOP3 = Q("orders").order_by("o_totalprice", "desc").limit(3)


@query(f"WITH {FLAGSHIP_SQL} SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p) AND o_orderstatus = 'F'")
def related_set(c):
    q = FLAGSHIP.related("orders", CUSTOMER_ORDERS, Q("orders").where("o_orderstatus", "F"))
    return all_rows(q.ast, c)[1][1].select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {FLAGSHIP_SQL}, {RANKED_SQL} SELECT o_orderkey, o_custkey, o_totalprice FROM r WHERE rn <= 3")
def related_top_n(c):
    return all_rows(FLAGSHIP.related("orders", CUSTOMER_ORDERS, TOP3).ast, c)[1][1].select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"WITH {FLAGSHIP_SQL} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM p) AND o_orderkey > 500")
def related_cursor(c):
    q = FLAGSHIP.related("orders", CUSTOMER_ORDERS, Q("orders").order_by("o_orderkey").start({"o_orderkey": 500}))
    return all_rows(q.ast, c)[1][1].select("o_orderkey", "o_custkey")


@query(f"WITH {FLAGSHIP_SQL}, {RANKED_SQL} SELECT c_custkey, rn AS place, o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS n_lines FROM p JOIN r ON o_custkey = c_custkey WHERE rn <= 3")
def related_nested(c):
    lines = Q("lineitem").where("l_quantity", ">", 25)
    q = FLAGSHIP.related("orders", CUSTOMER_ORDERS, TOP3.related("lines", ORDER_LINES, lines))
    rows = nested(q.ast, c).select("c_custkey", F.posexplode("orders").alias("i", "o"))
    return rows.select("c_custkey", (F.col("i") + 1).cast("long").alias("place"), "o.o_orderkey", F.size("o.lines").cast("long").alias("n_lines"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 350000")
def related_singular(c):
    customer = Q("customer").related("nation", ("nation", "c_nationkey", "key"))
    q = Q("orders").where("o_totalprice", ">", 350000).related("customer", ("customer", "o_custkey", "c_custkey"), customer)
    rows = nested(q.ast, c, singles=frozenset({"customer", "customer.nation"}))
    return rows.select("o_orderkey", "customer.c_name", F.col("customer.nation.name").alias("n_name"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders")
def related_empty_list(c):
    return nested(Q("orders").related("lines", ORDER_LINES).ast, c).select("o_orderkey", F.size("lines").cast("long").alias("n_lines"))


@query("""WITH j AS (SELECT o_orderkey, p_partkey, p_size, row_number() OVER (PARTITION BY o_orderkey ORDER BY p_size DESC, p_partkey) AS rn
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 10)
          SELECT o_orderkey, rn AS place, p_size FROM j WHERE rn <= 2""")
def related_junction(c):
    parts = Q("part").where("p_size", ">", 10).order_by("p_size", "desc").limit(2)
    q = Q("orders").related("link", ORDER_LINES, Q("lineitem").related("parts", ("part", "l_partkey", "p_partkey"), parts), hidden=True)
    rows = nested(q.ast, c).select("o_orderkey", F.posexplode("parts").alias("i", "p"))
    return rows.select("o_orderkey", (F.col("i") + 1).cast("long").alias("place"), "p.p_size")


CLOSURE = Q("customer").where("c_acctbal", ">", 9500).where_exists(CUSTOMER_ORDERS, Q("orders").where("o_orderstatus", "P")).related("nation", ("nation", "c_nationkey", "key"))
CLOSURE_SQL = """r AS (SELECT * FROM customer WHERE c_acctbal > 9500 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')),
k AS (SELECT 'customer' AS row_table, '{"c_custkey":' || c_custkey || '}' AS row_pk FROM r
      UNION SELECT 'nation', '{"key":' || c_nationkey || '}' FROM r
      UNION SELECT 'orders', '{"o_orderkey":' || o_orderkey || '}' FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM r))"""


@query(f"WITH {CLOSURE_SQL} SELECT row_table, row_pk FROM k")
def dependent_closure(c):
    return closure(CLOSURE.ast, c)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0 AND o_totalprice > 200000")
def narrowing_probe(c):
    changed = c.scan("orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return probe(Q("orders").where("o_totalprice", ">", 200000).limit(1).ast, c, changed)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100")
def wire_query(c):
    wire = {"table": "orders", "orderBy": [["o_orderkey", "asc"]], "where": {"type": "and", "conditions": [
        {"type": "simple", "op": "=", "left": {"type": "column", "name": "o_orderstatus"}, "right": {"type": "literal", "value": "F"}},
        {"type": "simple", "op": ">=", "left": {"type": "column", "name": "o_totalprice"}, "right": {"type": "literal", "value": 100}}]}}
    return flat(parse(wire), c).select("o_orderkey")


# ---- aggregates ----

BY_CUSTOMER = aggregates.Aggregate("order_stats", "orders", {"o_custkey": "custkey"}, "n_orders", {"total_due": "due"})


@query(f"WITH o AS ({DUE}) SELECT o_custkey AS custkey, count(*) AS n_orders, coalesce(sum(due), 0) AS total_due FROM o GROUP BY o_custkey")
def agg_count_sum_full(c):
    return aggregates.full(c.scan("orders"), BY_CUSTOMER)


def order_changes(c) -> DataFrame:
    """Changes of orders by key: of every 10 one goes, one moves to another customer, one changes its due value, one is new."""
    o = c.scan("orders")
    row = F.struct(*o.columns)
    none = F.lit(None).cast(o.select(row.alias("r")).schema["r"].dataType)
    kind = F.col("o_orderkey") % 10
    moved = F.struct(*(F.col(x) if x != "o_custkey" else (F.col("o_custkey") % 50 + 1).cast("long").alias(x) for x in o.columns))
    raised = F.struct(*(F.col(x) if x != "due" else (F.coalesce("due", F.lit(0.0)) + 10).alias(x) for x in o.columns))
    added = F.struct(*(F.col(x) if x != "o_orderkey" else (F.col("o_orderkey") + 100000000).alias(x) for x in o.columns))
    op = F.when(kind == 0, "DELETE").when(kind.isin(1, 2), "UPDATE").otherwise("INSERT")
    old, new = F.when(kind <= 2, row).otherwise(none), F.when(kind == 1, moved).when(kind == 2, raised).when(kind == 3, added).otherwise(none)
    return o.where(kind <= 3).select((F.col("o_orderkey") + 1).alias("watermark"), op.alias("op"), old.alias("old"), new.alias("new"))


CHANGED = f"""WITH o AS ({DUE}), a AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN o_custkey % 50 + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
         CASE WHEN o_orderkey % 10 = 2 THEN coalesce(due, 0) + 10 ELSE due END AS due FROM o WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, due FROM o WHERE o_orderkey % 10 = 3)"""


@query(f"{CHANGED} SELECT o_custkey AS custkey, count(*) AS n_orders, coalesce(sum(due), 0) AS total_due FROM a GROUP BY o_custkey")
def agg_delta_merge(c):
    return aggregates.merge(aggregates.full(c.scan("orders"), BY_CUSTOMER), aggregates.delta(order_changes(c), BY_CUSTOMER), BY_CUSTOMER)


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS n_open FROM customer")
def agg_existing_parent(c):
    d = aggregates.Aggregate("open_orders", "orders", {"o_custkey": "c_custkey"}, "n_open", target="customer")
    return aggregates.backfill_existing(c.scan("customer").select("c_custkey", "c_name"), c.scan("orders").where("o_orderstatus = 'P'"), d)


@query(f"{CHANGED} SELECT c_custkey, (SELECT count(*) FROM a WHERE a.o_custkey = c_custkey) AS n_orders FROM customer")
def agg_existing_delta(c):
    d = aggregates.Aggregate("all_orders", "orders", {"o_custkey": "c_custkey"}, "n_orders", target="customer")
    parents = aggregates.backfill_existing(c.scan("customer").select("c_custkey"), c.scan("orders"), d)
    return aggregates.merge_existing(parents, aggregates.delta(order_changes(c), d), d)


@query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
          SELECT event_type, p, value FROM s, (VALUES (50.0::DOUBLE), (95.0), (99.0)) t(p) WHERE i = least(floor(p / 100 * n), n - 1)""")
def percentile_nearest_rank(c):
    return aggregates.nearest_rank(c.scan("events"), "value", [50, 95, 99], ["event_type"])


# ---- membership and patches ----


def two_versions(c) -> tuple[DataFrame, DataFrame]:
    """Membership of two queries before and after orders have changed."""
    queries = {"big": Q("orders").where("o_totalprice", ">", 300000).ast, "open": Q("orders").where("o_orderstatus", "P").ast}
    after = c.bind(orders=cdc.apply(c.scan("orders"), order_changes(c), ["o_orderkey"]))
    # each side is used several times below: it is worked out once
    return settle(membership.members(queries, c), "members"), settle(membership.members(queries, after), "members")


MEMBERS = CHANGED + """, q AS (SELECT 'big' AS query, o_orderkey, 'b' AS v FROM o WHERE o_totalprice > 300000 UNION ALL SELECT 'open', o_orderkey, 'b' FROM o WHERE o_orderstatus = 'P'
  UNION ALL SELECT 'big', o_orderkey, 'a' FROM a WHERE o_totalprice > 300000 UNION ALL SELECT 'open', o_orderkey, 'a' FROM a WHERE o_orderstatus = 'P'),
d AS (SELECT query, '{"o_orderkey":' || o_orderkey || '}' AS row_pk, sum(CASE v WHEN 'a' THEN 1 ELSE -1 END) AS change FROM q GROUP BY query, o_orderkey),
n AS (SELECT '{"o_orderkey":' || o_orderkey || '}' AS row_pk, sum(CASE v WHEN 'a' THEN 1 ELSE 0 END) AS a, sum(CASE v WHEN 'b' THEN 1 ELSE 0 END) AS b FROM q GROUP BY o_orderkey)"""


@query(f"{MEMBERS} SELECT query, row_pk, CAST(change AS INTEGER) AS change FROM d WHERE change <> 0")
def membership_diff(c):
    before, after = two_versions(c)
    return membership.membership_diff(after, before).select("query", "row_pk", "change")


@query(f"{MEMBERS} SELECT row_pk, CAST(a - b AS BIGINT) AS delta FROM n WHERE a <> b")
def refcount_delta(c):
    before, after = two_versions(c)
    return membership.net_delta(membership.membership_diff(after, before)).select("row_pk", "delta")


def refs_of(before: DataFrame) -> DataFrame:
    return before.groupBy(*membership.KEY).agg(F.count("*").alias("refs")).withColumns({"added": F.lit(1).cast("long"), "removed": F.lit(None).cast("long")})


@query(f"{MEMBERS} SELECT CASE WHEN b = 0 THEN 'put' WHEN a = 0 THEN 'del' ELSE 'put' END AS op, row_pk FROM n WHERE (a > 0) <> (b > 0) OR (a > 0 AND CAST(regexp_extract(row_pk, '[0-9]+') AS BIGINT) % 10 IN (1, 2))")
def patch_rows(c):
    before, after = two_versions(c)
    refs = membership.apply_delta(refs_of(before), membership.net_delta(membership.membership_diff(after, before)), 2)
    changed = order_changes(c).where("op = 'UPDATE'").select(F.lit("orders").alias("row_table"), F.to_json(F.struct("new.o_orderkey")).alias("row_pk"))
    return membership.row_patch(refs, changed, after).select("op", "row_pk")


@query(f"{MEMBERS} SELECT CASE WHEN b = 0 THEN 'put' ELSE 'del' END AS op, row_pk FROM n WHERE (a > 0) <> (b > 0)")
def transition_replay(c):
    before, after = two_versions(c)
    refs = membership.apply_delta(refs_of(before), membership.net_delta(membership.membership_diff(after, before)), 2)
    return membership.replay(refs, 1).select("op", "row_pk")


@query(f"{CHANGED}, t AS (SELECT o_orderkey FROM o WHERE o_orderkey % 10 <= 2 UNION SELECT o_orderkey + 100000000 FROM o WHERE o_orderkey % 10 = 3) SELECT CASE WHEN o_orderkey IN (SELECT o_orderkey FROM a) THEN 'put' ELSE 'del' END AS op, o_orderkey FROM t")
def cursor_diff_patch(c):
    changes = order_changes(c)
    return membership.cursor_diff(cdc.touched(changes, ["o_orderkey"]), cdc.apply(c.scan("orders"), changes, ["o_orderkey"]), ["o_orderkey"])


# ---- change capture and mutations ----


@query(f"{CHANGED} SELECT o_orderkey, o_custkey, o_orderstatus, due FROM a")
def cdc_apply_latest(c):
    return cdc.apply(c.scan("orders"), order_changes(c), ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus", "due")


@query("SELECT CASE WHEN r_regionkey = 2 THEN 102 ELSE r_regionkey END AS r_regionkey, r_name FROM region")
def pk_change_update(c):
    r = c.scan("region")
    move = r.where("r_regionkey = 2").select(F.lit(1).cast("long").alias("watermark"), F.lit("UPDATE").alias("op"), F.struct("r_regionkey", "r_name").alias("old"), F.struct(F.lit(102).alias("r_regionkey"), "r_name").alias("new"))
    return cdc.apply(r, move, ["r_regionkey"])


@query(f"{CHANGED} SELECT 'DELETE' AS op, o_orderkey, o_custkey AS old_custkey, NULL::BIGINT AS new_custkey, due AS old_due, NULL::DOUBLE AS new_due FROM o WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'INSERT', o_orderkey, NULL, o_custkey, NULL, due FROM a WHERE o_orderkey > 100000000 UNION ALL SELECT 'UPDATE', o.o_orderkey, o.o_custkey, a.o_custkey, o.due, a.due FROM o JOIN a USING (o_orderkey) WHERE o.o_custkey IS DISTINCT FROM a.o_custkey OR o.due IS DISTINCT FROM a.due")
def snapshot_diff_capture(c):
    before = c.scan("orders")
    rows = cdc.capture(before, cdc.apply(before, order_changes(c), ["o_orderkey"]), ["o_orderkey"])
    return rows.select("op", "o_orderkey", F.col("old.o_custkey").alias("old_custkey"), F.col("new.o_custkey").alias("new_custkey"), F.col("old.due").alias("old_due"), F.col("new.due").alias("new_due"))


@query("SELECT event_id AS watermark, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 250")
def cdc_poll(c):
    return cdc.poll(c.scan("events").select(F.col("event_id").alias("watermark"), "event_type"), 100, 250)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 300 ORDER BY o_orderkey LIMIT 120")
def snapshot_page(c):
    return readers.page(c, "orders", {"o_orderkey": 300}, 120)[0].select("o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0
          UNION ALL SELECT c_custkey + 1000000, 'NEW', NULL FROM customer WHERE c_custkey % 4 = 0""")
def upsert_insert_update_delete(c):
    spec = c.spec("customer")
    t = c.scan("customer")
    rows = t.where("c_custkey % 3 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment"))
    t = mutations.update(t, rows, spec)
    new = t.where("c_custkey % 4 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"))
    t = mutations.upsert(t, new, spec)
    t = mutations.insert(t, t.where("c_custkey < 1000000").select("c_custkey", F.lit("IGNORED").alias("c_mktsegment")), spec)
    return mutations.delete(t, t.where("c_custkey < 1000000 AND c_custkey % 5 = 0").select("c_custkey"), spec).select("c_custkey", "c_mktsegment", "c_acctbal")


KEYS = [mutations.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",), "cascade"), mutations.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",), "cascade"), mutations.ForeignKey("customer", ("c_nationkey",), "nation", ("key",), "set null")]


@query("""WITH d AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9900), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM d))
          SELECT 'customer' AS t, c_custkey AS key, 1::BIGINT AS n FROM d UNION ALL SELECT 'orders', o_orderkey, 1 FROM o UNION ALL SELECT 'lineitem', l_orderkey, count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY l_orderkey""")
def fk_cascade_delete(c):
    tables = {t: c.scan(t) for t in ("customer", "orders", "lineitem")}
    steps = mutations.expand_delete("customer", tables["customer"].where("c_acctbal > 9900"), tables, KEYS)
    key = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [rows.groupBy(F.lit(table).alias("t"), F.col(key[table]).alias("key")).agg(F.count("*").alias("n")) for action, table, rows, _ in steps if action == "delete"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS c_nationkey FROM customer")
def fk_set_null(c):
    tables = {t: c.scan(t) for t in ("customer", "nation")}
    steps = mutations.expand_delete("nation", tables["nation"].where("key = 3"), tables, KEYS)
    hit = next(rows for action, table, rows, _ in steps if action == "set null")
    return mutations.update(tables["customer"], hit.select("c_custkey", F.lit(None).cast("int").alias("c_nationkey")), c.spec("customer")).select("c_custkey", "c_nationkey")


def ledger(c) -> DataFrame:
    return c.scan("events").select((F.col("event_id") + 1).alias("version"), F.lit("users").alias("row_table"), F.to_json(F.struct("user_id")).alias("row_pk"))


@query("""SELECT DISTINCT '{"user_id":' || user_id || '}' AS row_pk FROM events WHERE event_id + 1 > 9000""")
def ledger_scan(c):
    return cdc.ledger_scan(ledger(c), 9000).select("row_pk")


@query("SELECT event_id + 1 AS version FROM events WHERE event_id + 1 > 500 AND event_id % 97 <> 0 AND (event_id - 1) % 97 = 0 AND event_id + 1 <> 501 ")
def ledger_gaps(c):
    return cdc.ledger_gaps(ledger(c).where("(version - 1) % 97 <> 0"), 500)


# ---- windows over time, streams, histories ----

MS = "(epoch_us(ts) // 1000)"


@query(f"""WITH b AS (SELECT event_type, CAST(floor({MS} / 60000) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS amount FROM events GROUP BY ALL)
           SELECT event_type, bucket, amount, CAST(sum(amount) OVER (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling FROM b""")
def rolling_budget(c):
    return budget.rolling_sum(timed(c), ["event_type"], "ms", "one", 3_600_000, 60_000)


def epoch_ms(column: str):
    """A timestamp without zone as epoch milliseconds in UTC, whatever the session's zone."""
    return F.unix_millis(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def timed(c) -> DataFrame:
    return c.frames["events"].select("event_id", "user_id", "event_type", "value", epoch_ms("ts").alias("ms"), F.lit(1).alias("one"))


@query(f"""WITH b AS (SELECT event_type, CAST(floor({MS} / 60000) AS BIGINT) AS bucket, count(*) AS amount FROM events GROUP BY ALL),
           r AS (SELECT event_type, bucket, sum(amount) OVER (PARTITION BY event_type ORDER BY bucket RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS rolling FROM b),
           t AS (SELECT event_type, bucket, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS trip FROM r WHERE rolling > 2)
           SELECT event_type, bucket, CAST(trip AS INTEGER) AS trip, CAST(least(60000, 1000 * pow(2, least(trip - 1, 40))) AS BIGINT) AS pause_ms FROM t""")
def breaker_trips(c):
    rolling = budget.rolling_sum(timed(c), ["event_type"], "ms", "one", 3_600_000, 60_000)
    return budget.breaker(rolling, ["event_type"], 2, 1000, 60_000).select("event_type", "bucket", "trip", "pause_ms")


@query(f"""WITH e AS (SELECT event_id, user_id, {MS} AS ms FROM events),
           c AS (SELECT user_id, event_id AS version, ms FROM e WHERE event_id % 2 = 0), s AS (SELECT user_id, event_id AS version, ms FROM e WHERE event_id % 2 = 1)
           SELECT c.user_id, c.version, coalesce(CASE WHEN min(s.ms) IS NOT NULL THEN greatest(0, min(s.ms) - c.ms) END, -1) AS lag FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.version >= c.version GROUP BY c.user_id, c.version, c.ms""")
def serving_lag(c):
    e = timed(c).select(F.col("user_id").alias("group"), F.col("event_id").alias("version"), F.col("ms").alias("at"))
    return budget.serving_lag(e.where("version % 2 = 0"), e.where("version % 2 = 1")).select(F.col("group").alias("user_id"), "version", F.coalesce("lag", F.lit(-1)).cast("long").alias("lag"))


@query(f"{CHANGED} SELECT o_orderkey, o_custkey, o_orderstatus, due FROM a")
def stream_foreach_batch(c):
    """The changes as a stream in two parts, each a micro-batch that is applied to a versioned table."""
    spark, base, changes = c.frames["orders"].sparkSession, shared_path(c.frames["orders"].sparkSession, "stream"), order_changes(c)
    table = ingest.VersionedTable(spark, f"{base}/table", c.scan("orders").schema, ["o_orderkey"])
    table.create(c.scan("orders"))
    half = changes.agg(F.max("watermark")).first()[0] // 2
    for part in (f"watermark <= {half}", f"watermark > {half}"):
        changes.where(part).write.mode("append").parquet(f"{base}/changes")  # as many files as tasks: no task writes all
        stream = spark.readStream.schema(changes.schema).parquet(f"{base}/changes")
        ingest.ingest(stream, table, f"{base}/progress").awaitTermination()
    table.purge()
    return table.read().select("o_orderkey", "o_custkey", "o_orderstatus", "due")


FIELDS_SQL = """WITH f AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
          l AS (SELECT user_id, event_type FROM f WHERE back = 1)
          SELECT CAST(e.user_id AS VARCHAR) AS topic, e.event_type AS stream, string_agg(CAST(e.event_id AS VARCHAR) || ';', '' ORDER BY e.event_id) AS value, max(e.event_id) AS seq
          FROM events e JOIN l USING (user_id, event_type) GROUP BY e.user_id, e.event_type"""


def event_frames(c) -> DataFrame:
    """Events as frames of field streams: a user is a topic, an event type a generation that starts with its last event."""
    e = c.scan("events")
    starts = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("started"))
    return e.join(starts, ["user_id", "event_type"]).select(
        F.col("user_id").cast("string").alias("topic"), F.col("event_type").alias("stream"), "started", F.col("event_id").alias("seq"), F.lit("append").alias("mode"),
        F.concat(F.col("event_id").cast("string"), F.lit(";")).alias("value"), F.lit(False).alias("ended"),
    )


@query(FIELDS_SQL)
def field_stream_live(c):
    """The same as a stream with state for each topic; each batch's states are written as they are put out."""
    spark, base, frames = c.frames["events"].sparkSession, shared_path(c.frames["events"].sparkSession, "fields"), event_frames(c)
    frames.write.parquet(f"{base}/frames")
    states = fields.live_fields(spark.readStream.schema(frames.schema).parquet(f"{base}/frames"), max_bytes=None)
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/states/batch={n}")
    states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    states = spark.read.schema(f"{fields.OUT}, batch long").parquet(f"{base}/states")
    last = states.groupBy("topic").agg(F.max_by(F.struct("stream", "value", "seq"), "batch").alias("s"))
    return last.select("topic", "s.stream", "s.value", "s.seq")


@query(FIELDS_SQL)
def field_stream_accumulate(c):
    return fields.accumulate(event_frames(c)).select("topic", "stream", "value", "seq")


@query(f"""WITH e AS (SELECT user_id, event_id, value, {MS} AS ms FROM events), w AS (SELECT user_id, floor(ms / 3600000) AS w, max(ms) AS last_at, arg_max(value, (ms, event_id)) AS value FROM e GROUP BY 1, 2)
           SELECT CAST(user_id AS VARCHAR) AS topic, last_at, value FROM w""")
def publisher_coalesce(c):
    e = timed(c).select(F.col("user_id").cast("string").alias("topic"), F.col("ms").alias("at"), F.struct("ms", "event_id", "value").alias("value"))
    return fields.coalesced(e, 3_600_000, "value").select("topic", F.col("at").alias("last_at"), "value.value")


@query("SELECT user_id, event_id, before, value FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value < before")
def history_monotonic(c):
    return history.monotonic(c.scan("events"), ["user_id"], "value", "event_id")


@query("""WITH e AS (SELECT o_custkey AS g, o_orderkey AS k FROM orders), r AS (SELECT l_suppkey % 5 AS read, l_orderkey AS k, max(CASE WHEN l_quantity > 25 THEN 2 END) AS v FROM lineitem GROUP BY 1, 2),
          m AS (SELECT g, read, count(*) AS covered, sum(CASE WHEN v >= 1 THEN 1 ELSE 0 END) AS seen FROM e JOIN r USING (k) GROUP BY 1, 2)
          SELECT m.g, m.read, CAST(seen AS BIGINT) AS seen, n AS effects FROM m JOIN (SELECT g, count(*) AS n FROM e GROUP BY g) USING (g) WHERE covered = n AND seen > 0 AND seen < n""")
def atomic_visibility(c):
    effects = c.scan("orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("key"), F.lit(1).alias("version"))
    reads = c.scan("lineitem").groupBy((F.col("l_suppkey") % 5).alias("read"), F.col("l_orderkey").alias("key")).agg(F.max(F.when(F.col("l_quantity") > 25, 2)).alias("version"))
    return history.atomic_visibility(effects, reads).withColumnRenamed("group", "g")


# ---- values ----


@query("""WITH e AS (SELECT event_id, epoch_ms(ts) // 1000 * 1000 AS s FROM events)
          SELECT event_id, 'blank' AS form, CAST(s AS DOUBLE) AS ms FROM e UNION ALL SELECT event_id, 'zulu', s FROM e UNION ALL SELECT event_id, 'fraction', s + 125 FROM e UNION ALL SELECT event_id, 'offset', s - 19800000 FROM e
          UNION ALL SELECT event_id, 'short offset', s + 7200000 FROM e UNION ALL SELECT event_id, 'number', event_id + 0.5 FROM e UNION ALL SELECT event_id, 'padded', NULL FROM e UNION ALL SELECT event_id, 'date', NULL FROM e""")
def ts_text_to_epoch_ms(c):
    at = lambda pattern, tail="": F.concat(F.date_format("ts", pattern), F.lit(tail))
    second, plain = "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"
    forms = {"blank": at(plain), "zulu": at(second, "Z"), "fraction": at(second, ".125999Z"), "offset": at(plain, "+0530"), "short offset": at(second, "-02"),
             "number": (F.col("event_id") + 0.5).cast("string"), "padded": F.concat(F.lit(" "), at(plain)), "date": at("yyyy-MM-dd")}
    rows = c.frames["events"].select("event_id", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("text")) for k, v in forms.items()))).alias("f"))
    return rows.select("event_id", "f.form", values.text_to_number(F.col("f.text")).alias("ms"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS pk FROM events""")
def canonical_pk(c):
    return c.scan("events").select("event_id", values.canonical_pk("event_id", "event_type").alias("pk"))


@query("""SELECT event_id, replace(props, ' ', '') AS props FROM events""")
def canonical_json(c):
    return c.scan("events").select("event_id", values.canonical_json(F.col("props")).alias("props"))


from . import state_queries  # noqa: E402, F401  registers more
