"""Registered queries of state, pushes, desires, ledgers and histories, each with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import values
from .operators import aggregates, cdc, desires, history, membership, mutations
from .plans import registry
from .plans.ast import Q
from .plans.catalog import Catalog
from .queries import BY_CUSTOMER, CHANGED, CUSTOMER_ORDERS, FLAGSHIP, FLAGSHIP_SQL, MS, ORDER_LINES, RANKED_SQL, TOP3, ledger, order_changes, query, timed
from .sources import readers, sinks
from .sources.shared import shared_path
from .streaming import fields

# ---- sources and sinks ----


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def point_lookup(c):
    keys = c.scan("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return readers.lookup(c.scan("customer"), keys, ["c_custkey"]).select("c_custkey", "c_name")


@query(f"{CHANGED} SELECT o_orderkey, o_custkey, o_orderstatus, due FROM a")
def staged_snapshot(c):
    """Two pages gathered aside; the changes since the first are replayed when they are swapped in."""
    stage, o = cdc.StagedSnapshot({"orders": ["o_orderkey"]}, "s1"), c.scan("orders")
    stage.add("orders", o.where("o_orderstatus = 'F'"), "s1", 5, False)
    stage.add("orders", o.where("o_orderstatus <> 'F'"), "s1", 0, True)
    return stage.finish({"orders": order_changes(c)})["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "due")


@query(r"""SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || chr(1) || '\' || chr(9) || 'n' || chr(10) || '\t' AS name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS segment FROM customer""")
def copy_dump_rows(c):
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n"))
    name = F.concat("c_name", F.lit("\x01\\\tn\n\\t"))
    segment = F.when(F.col("c_acctbal") >= 0, escaped(F.col("c_mktsegment"))).otherwise(F.lit("\\N"))
    lines = c.scan("customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), escaped(name), segment).alias("value"))
    return readers.copy_rows(lines, ["key", "name", "segment"])


@query("SELECT n_nationkey AS key, n_name AS name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def backup_restore(c):
    path, spark = shared_path(c.frames["nation"].sparkSession, "backup"), c.frames["nation"].sparkSession
    sinks.backup(Catalog(c.spec("nation"), c.spec("region")).bind(nation=c.frames["nation"], region=c.frames["region"]), path)
    back = sinks.restore(spark, path)
    return back["nation"].join(back["region"], F.col("region") == F.col("r_regionkey")).select("key", "name", "r_name")


@query("""SELECT CASE WHEN n_regionkey = 1 THEN 'del' ELSE 'put' END AS op, 'nation' AS table_name, '{"key":' || n_nationkey || '}' AS id,
          CASE WHEN n_regionkey <> 1 THEN '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' END AS value FROM nation""")
def patch_values(c):
    patch = c.scan("nation").select(F.when(F.col("region") == 1, "del").otherwise("put").alias("op"), F.lit("nation").alias("row_table"), values.canonical_pk("key").alias("row_pk"))
    return membership.with_values(patch, "nation", c)


@query("SELECT event_id AS id, event_type AS source FROM events WHERE user_id % 4 <= 2 AND event_id > 100 ORDER BY event_id DESC LIMIT 50")
def log_query(c):
    logs = c.scan("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("user_id") % 4).alias("priority"))
    return readers.log_entries(logs, level=2, since=100, last=50).select("id", "source")


# ---- execution ----


@query("SELECT n_nationkey AS key, CAST((row_number() OVER (ORDER BY n_name, n_nationkey) - 1) // 7 AS INTEGER) AS page FROM nation")
def batched_iteration(c):
    pages = registry.batches(Q("nation").order_by("name").ast, c, 7)
    return reduce(DataFrame.unionByName, (p.select("key", F.lit(i).alias("page")) for i, p in enumerate(pages)))


@query(f"""WITH {FLAGSHIP_SQL}, {RANKED_SQL}, t AS (SELECT o_orderkey FROM r WHERE rn <= 3) SELECT 'customer' AS path, count(*) AS n FROM p
           UNION ALL SELECT 'customer/orders', count(*) FROM t UNION ALL SELECT 'customer/orders/lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM t)""")
def select_budget(c):
    q = FLAGSHIP.related("orders", CUSTOMER_ORDERS, TOP3.related("lineitem", ORDER_LINES))
    return reduce(DataFrame.unionByName, (df.agg(F.lit(path).alias("path"), F.count("*").alias("n")) for path, df in registry.within_budget(q.ast, c)))


@query("SELECT event_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS whole, CAST(floor(value) + 0.5 AS VARCHAR) AS half FROM events")
def json_numbers(c):
    whole = F.floor("value").cast("double")
    return c.scan("events").select("event_id", values.json_number(whole).alias("whole"), values.json_number(whole + 0.5).alias("half"))


# ---- writes and pushes ----


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'undeclared' ELSE 'unwritten' END AS problem FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'P') OR o_totalprice < 1500")
def write_set(c):
    o = c.scan("orders")
    declared = o.where("(o_totalprice > 100000 AND o_orderstatus <> 'P') OR o_totalprice < 1500")
    return mutations.check_write_set(o.where("o_totalprice > 100000"), declared, ["o_orderkey"])


def pushed(c) -> DataFrame:
    """Events as mutations: a user is a client whose ids count its events."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return c.scan("events").select(F.col("user_id").alias("client"), "event_id", "event_type", n.alias("id"), F.concat(F.lit("u"), "user_id").alias("user"))


def clients(c) -> DataFrame:
    """A client for each user, which two mutations have reached; every seventh belongs to another user."""
    user = F.when(F.col("client") % 7 == 0, "other").otherwise(F.concat(F.lit("u"), "client"))
    return c.scan("events").select(F.col("user_id").alias("client")).distinct().select("client", F.lit(2).cast("long").alias("last_id"), user.alias("user"))


PUSHED = """WITH e AS (SELECT user_id AS client, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events),
w AS (SELECT client, id, CASE WHEN id > 2 THEN 2 + row_number() OVER (PARTITION BY client, id > 2 ORDER BY id) END AS want FROM e WHERE event_id % 50 <> 0),
v AS (SELECT client, id, CASE WHEN client % 7 = 0 THEN 'forbidden' WHEN want IS NULL THEN 'replay' WHEN id = want THEN 'apply' ELSE 'gap' END AS verdict FROM w)"""


@query(f"{PUSHED} SELECT client, id, verdict FROM v")
def push_preflight(c):
    return mutations.preflight(pushed(c).where("event_id % 50 <> 0"), clients(c))


@query(f"""{PUSHED} SELECT c.client, greatest(2, coalesce(max(v.id), 0)) AS last_id, count(CASE WHEN v.id % 5 <> 0 THEN 1 END) AS effects
           FROM (SELECT DISTINCT client FROM e) c LEFT JOIN v ON v.client = c.client AND verdict = 'apply' GROUP BY c.client""")
def app_errors(c):
    """Every fifth mutation fails in the application: its effect goes, its id counts."""
    verdicts = mutations.preflight(pushed(c).where("event_id % 50 <> 0"), clients(c))
    effects, after = mutations.run_mutations(verdicts, pushed(c).where("id % 5 = 0"), pushed(c).select("client", "id", "event_type"), clients(c))
    return after.join(effects.groupBy("client").agg(F.count("*").alias("n")), "client", "left").select("client", "last_id", F.coalesce("n", F.lit(0)).alias("effects"))


@query("SELECT user_id AS client, greatest(2, count(*)) AS last_id FROM events GROUP BY user_id")
def settle_in_order(c):
    sent = pushed(c).select(F.col("event_id").alias("seq"), "client", "id")
    return mutations.settle_in_order(sent, sent, clients(c))


@query("""WITH b AS (SELECT user_id AS push, max(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS broken FROM events GROUP BY user_id)
          SELECT push, CASE WHEN push % 11 = 0 THEN 'unsupported version' ELSE 'malformed mutation' END AS problem FROM b WHERE push % 11 = 0 OR broken = 1""")
def push_validation(c):
    n = F.when(F.col("event_id") % 97 == 0, 0).otherwise(F.col("id"))
    rows = pushed(c).select(F.col("client").alias("push"), F.when(F.col("client") % 11 == 0, 2).otherwise(1).alias("version"), "client", n.alias("id"), F.col("event_type").alias("name"))
    return mutations.check_pushes(rows)[1]


# ---- queries, desires, membership ----


def definitions(c) -> DataFrame:
    """Customers as registered queries, of version 1 or 2, computed where they have no debts."""
    return c.scan("customer").select(F.col("c_custkey").alias("query"), F.col("c_mktsegment").alias("definition"), F.lit("customer").alias("root_table"), F.array(F.lit("customer")).alias("dependencies"),
                                     (1 + F.col("c_custkey") % 2).alias("version"), (F.col("c_acctbal") >= 0).alias("computed"))


@query("""SELECT c_custkey AS query, CASE WHEN c_nationkey <> 3 AND c_acctbal > 5000 THEN 'changed' ELSE c_mktsegment END AS definition, CASE WHEN c_nationkey <> 3 THEN 1 ELSE 1 + c_custkey % 2 END AS version,
          c_acctbal >= 0 AND (c_nationkey = 3 OR (c_acctbal <= 5000 AND c_custkey % 2 = 0)) AS computed FROM customer UNION ALL SELECT n_nationkey + 100000000, n_name, 1, false FROM nation""")
def register_queries(c):
    """Most definitions are asked for again, some changed, some of another version, and new ones."""
    form = lambda df, query, definition: df.select(query.cast("long").alias("query"), definition.alias("definition"), F.lit("customer").alias("root_table"), F.array(F.lit("customer")).alias("dependencies"), F.lit(1).cast("long").alias("version"))
    again = form(c.scan("customer").where("c_nationkey <> 3"), F.col("c_custkey"), F.when(F.col("c_acctbal") > 5000, "changed").otherwise(F.col("c_mktsegment")))
    new = form(c.scan("nation"), F.col("key") + 100000000, F.col("name"))
    return membership.register(definitions(c), again.unionByName(new)).select("query", "definition", "version", "computed")


@query("""SELECT 'definition' AS what, c_custkey AS key, c_acctbal >= 0 AND c_custkey % 2 = 1 AS flag FROM customer UNION ALL SELECT 'row', o_orderkey, NULL FROM orders WHERE o_custkey % 2 = 1
          UNION ALL SELECT 'client', n_nationkey, n_regionkey <> 2 FROM nation""")
def transform_version(c):
    rows = c.scan("orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("row_pk"))
    seen = c.scan("nation").select(F.col("key").cast("long").alias("client"), F.col("region").cast("long").alias("version"))
    known, left, reset = membership.change_version(definitions(c), rows, seen, 2)
    parts = known.select(F.lit("definition").alias("what"), F.col("query").alias("key"), F.col("computed").alias("flag")), left.select(F.lit("row").alias("what"), F.col("row_pk").alias("key"), F.lit(None).cast("boolean").alias("flag"))
    return parts[0].unionByName(parts[1]).unionByName(reset.select(F.lit("client").alias("what"), F.col("client").alias("key"), F.col("reset").alias("flag")))


@query(f"""{CHANGED}, t AS (SELECT o_orderkey FROM o WHERE o_orderkey % 10 <= 2 UNION SELECT o_orderkey + 100000000 FROM o WHERE o_orderkey % 10 = 3)
           SELECT o_orderkey FROM t WHERE o_orderkey IN (SELECT o_orderkey FROM o WHERE due > 150) OR o_orderkey IN (SELECT o_orderkey FROM a WHERE due > 150)""")
def touched_narrowing(c):
    changes = order_changes(c)
    after = c.bind(orders=cdc.apply(c.scan("orders"), changes, ["o_orderkey"]))
    return membership.narrowed(Q("orders").where("due", ">", 150).ast, after, cdc.touched(changes, ["o_orderkey"]), c.scan("orders").where("due > 150"))


@query("""WITH e AS (SELECT event_id AS seq, user_id AS client, event_type AS query, CASE WHEN event_id % 40 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'del' ELSE 'put' END AS op FROM events),
          c AS (SELECT client, max(seq) AS cleared FROM e WHERE op = 'clear' GROUP BY 1), l AS (SELECT client, query, arg_max(op, seq) AS op, max(seq) AS seq FROM e WHERE op <> 'clear' GROUP BY 1, 2),
          d AS (SELECT DISTINCT user_id AS client, 'search' AS query FROM events), b AS (SELECT client, query, d.client IS NOT NULL AS had, op, seq, cleared FROM d FULL JOIN l USING (client, query) LEFT JOIN c USING (client))
          SELECT client, query FROM b WHERE CASE WHEN op IS NOT NULL AND (cleared IS NULL OR seq > cleared) THEN op = 'put' ELSE query = 'search' AND had AND cleared IS NULL END""")
def desire_patch(c):
    e = c.scan("events")
    op = F.when(F.col("event_id") % 40 == 0, "clear").when(F.col("event_id") % 3 == 0, "del").otherwise("put")
    patch = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("client"), op.alias("op"), F.col("event_type").alias("query"))
    return desires.apply_patch(e.select(F.col("user_id").alias("client"), F.lit("search").alias("query")).distinct(), patch)


def held(c) -> DataFrame:
    return c.scan("orders").select(F.col("o_orderstatus").alias("query"), F.lit("orders").alias("row_table"), values.canonical_pk("o_orderkey").alias("row_pk"))


@query("""SELECT '{"o_orderkey":' || o_orderkey || '}' AS row_pk, -1 AS change FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def released_queries(c):
    desired = c.scan("orders").select(F.col("o_orderstatus").alias("query")).where("query IN ('F', 'O')")
    return membership.released(held(c), desired).select("row_pk", "change")


@query("""SELECT 0 AS seq, 'clear' AS op, NULL AS row_pk UNION ALL SELECT 1, 'put', '{"o_orderkey":' || o_orderkey || '}' FROM orders""")
def full_response(c):
    return membership.full_patch(held(c)).select("seq", "op", "row_pk")


@query("""SELECT row_pk FROM (SELECT c_custkey AS row_pk, c_nationkey AS removed, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS refs FROM customer) WHERE refs > 0 OR removed > 12""")
def tombstone_prune(c):
    n = c.scan("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    refs = c.scan("customer").join(n, "c_custkey", "left").select(F.col("c_custkey").alias("row_pk"), F.coalesce("n", F.lit(0)).alias("refs"), F.col("c_nationkey").alias("removed"))
    return membership.prune(refs, 12).select("row_pk")


@query("""WITH b AS (SELECT DISTINCT c_nationkey AS query FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0), a AS (SELECT DISTINCT c_nationkey AS query FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)
          SELECT 'put' AS op, query FROM a UNION ALL SELECT 'del', query FROM b WHERE query NOT IN (SELECT query FROM a)""")
def got_queries(c):
    of = lambda where: c.scan("customer").where(where).select(F.col("c_mktsegment").alias("client"), F.col("c_nationkey").alias("query")).distinct()
    return desires.got_queries(of("c_acctbal < 0"), of("c_acctbal > 9000"), "BUILDING")


@query("SELECT l_orderkey AS row_pk FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey HAVING min(l_returnflag) = 'N' AND max(l_returnflag) = 'N'")
def row_owners(c):
    rows = c.scan("lineitem").select(F.lit("lineitem").alias("row_table"), F.col("l_orderkey").alias("row_pk"), F.col("l_returnflag").alias("owner"), (F.col("l_quantity") - 5).alias("refs"))
    return desires.owners_match(rows, "N").select("row_pk")


@query(f"""{CHANGED}, d AS (
             SELECT o_custkey, -1 AS n, -coalesce(due, 0) AS t FROM o WHERE o_orderkey % 10 <= 2 UNION ALL SELECT o_custkey, 1, coalesce(due, 0) FROM a WHERE o_orderkey % 10 IN (1, 2) AND o_orderkey < 100000000
             UNION ALL SELECT o_custkey, 1, coalesce(due, 0) FROM a WHERE o_orderkey >= 100000000), p AS (SELECT o_custkey, sum(n) AS n, sum(t) AS t FROM d GROUP BY 1)
           SELECT b.o_custkey AS custkey, CAST(b.n + coalesce(p.n, 0) AS BIGINT) AS n_orders, b.t + coalesce(p.t, 0) AS total_due
           FROM (SELECT o_custkey, count(*) AS n, coalesce(sum(due), 0) AS t FROM o GROUP BY 1) b LEFT JOIN p USING (o_custkey)""")
def optimistic_overlay(c):
    base = aggregates.full(c.scan("orders"), BY_CUSTOMER)
    return desires.overlay(base, aggregates.delta(order_changes(c), BY_CUSTOMER), ["custkey"], ["n_orders", "total_due"])


# ---- ledger ----


@query("""WITH k AS (SELECT DISTINCT user_id AS txn, event_type AS row_table, CAST(event_id % 4 AS VARCHAR) AS row_pk FROM events), t AS (SELECT txn, sum(strlen(row_table) + strlen(row_pk)) AS bytes FROM k GROUP BY 1),
          n AS (SELECT txn, row_number() OVER (ORDER BY txn) AS nth, sum(bytes) OVER (ORDER BY txn) - bytes AS before FROM t)
          SELECT 7 + nth AS version, row_table, row_pk, CAST(3 + before // 1000 AS BIGINT) AS segment FROM k JOIN n USING (txn) UNION ALL SELECT 7, 'events', '0', 2""")
def ledger_append(c):
    spark = c.frames["events"].sparkSession
    known = spark.createDataFrame([(7, "events", "0", 2)], "version long, row_table string, row_pk string, segment long")
    writes = c.scan("events").select(F.col("user_id").alias("txn"), F.col("event_type").alias("row_table"), (F.col("event_id") % 4).cast("string").alias("row_pk"))
    return cdc.ledger_append(known, writes, rotate=1000)


@query("SELECT event_id + 1 AS version FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 1000")
def ledger_retention(c):
    rows = ledger(c)
    return cdc.retain(rows, rows.agg(F.max("version")).first()[0], 1000)[0].select("version")


@query("SELECT event_id + 1 AS version, event_id + 1 = (SELECT max(event_id) + 2 FROM events) AS floor FROM events UNION ALL SELECT max(event_id) + 2, true FROM events")
def epoch_invalidate(c):
    rows, floor = cdc.invalidate(ledger(c))
    return rows.select("version", (F.col("version") == floor).alias("floor"))


# ---- histories ----


@query(f"""WITH e AS (SELECT event_id - (SELECT min(event_id) FROM events) AS i, {MS} AS t, user_id, event_type AS kind, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) % 5 IN (1, 3) THEN 'invoke' ELSE 'ok' END AS type FROM events),
           w AS (SELECT *, lag(type) OVER p AS was, lag(kind) OVER p AS was_kind, lead(type) OVER p AS next FROM e WINDOW p AS (PARTITION BY user_id ORDER BY i))
           SELECT a.i AS index, 'time goes back' AS problem FROM e a JOIN e b ON a.i = b.i + 1 WHERE a.t < b.t UNION ALL SELECT i, 'invoke without an end' FROM w WHERE type = 'invoke' AND (next IS NULL OR next = 'invoke')
           UNION ALL SELECT i, CASE WHEN type = 'invoke' THEN 'invoke while another is open' WHEN was IS NULL OR was <> 'invoke' THEN 'end without an invoke' ELSE 'end of another kind' END FROM w
             WHERE (type = 'invoke' AND was = 'invoke') OR (type <> 'invoke' AND (was IS NULL OR was <> 'invoke' OR was_kind <> kind))
           UNION ALL SELECT i, 'gap in indexes' FROM e WHERE i <> 0 AND i - 1 NOT IN (SELECT i FROM e)""")
def history_validation(c):
    first, n = c.scan("events").agg(F.min("event_id"), F.count("*")).first()
    rows = timed(c).select((F.col("event_id") - first).alias("index"), F.col("ms").alias("time"), F.col("user_id").alias("process"), F.col("event_type").alias("kind"))
    # one deal and one sort for the types and their check; the order needs no types
    nth = F.row_number().over(Window.partitionBy("process").orderBy("index"))
    typed = history.spread(rows.drop("time"), n, "process").withColumn("type", F.when((nth % 5).isin(1, 3), "invoke").otherwise("ok"))
    return history.order_problems(rows, n).unionByName(history.operation_problems(typed))


@query("""WITH e AS (SELECT user_id AS client, event_id % 50 <> 0 AS applied, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM events), t AS (SELECT client, max(id) AS last, coalesce(max(CASE WHEN applied THEN id END), 0) AS top FROM e GROUP BY 1)
          SELECT DISTINCT client, 'acknowledged and not applied' AS problem FROM e WHERE NOT applied UNION ALL SELECT client, 'last id differs' FROM t WHERE last <> top""")
def exactly_once(c):
    rows = pushed(c).select("client", "id", (F.col("event_id") % 50 != 0).alias("applied"), F.lit(True).alias("acked"))
    return history.exactly_once(rows, rows.groupBy("client").agg(F.max("id").alias("last_id")))


@query("""SELECT o_custkey AS client, o_orderstatus AS key, o_orderkey AS version FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer
          WHERE c_custkey = o_custkey AND o_orderstatus = 'F' AND o_orderkey >= c_nationkey AND (c_acctbal > 0 OR o_orderkey < 500))""")
def permission_leaks(c):
    reads = c.scan("orders").select(F.col("o_custkey").alias("client"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("version"))
    grants = c.scan("customer").select(F.col("c_custkey").alias("client"), F.lit("F").alias("key"), F.col("c_nationkey").alias("since"), F.when(F.col("c_acctbal") <= 0, 500).alias("until"))
    return history.permission_leaks(reads, grants)


@query("SELECT user_id AS key, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS appended FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def append_lists(c):
    rows = c.scan("events").select(F.col("event_id").alias("index"), F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.lit("append").alias("kind"), F.when(F.col("event_id") % 3 == 0, "fail").otherwise("ok").alias("type"))
    return history.append_lists(rows).select("key", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("appended"))


# ---- fields ----


@query("SELECT CAST(user_id AS VARCHAR) AS topic, arg_max(event_type || ' ' || event_id, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def field_stream_replace(c):
    frames = c.scan("events").select(F.col("user_id").cast("string").alias("topic"), F.lit("one").alias("stream"), F.lit(0).alias("started"), F.col("event_id").alias("seq"), F.lit("replace").alias("mode"),
                                     F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"), F.lit(False).alias("ended"))
    return fields.accumulate(frames).select("topic", "value", "seq")


@query("""SELECT 'events' AS field_of, event_id FROM events WHERE event_type <> 'view' AND length(props) > 7 UNION ALL SELECT 'users', event_id FROM events WHERE event_type NOT IN ('view', 'click')""")
def field_checks(c):
    e = c.scan("events").select("event_id", F.struct("event_type", "props").alias("value"), F.explode(F.array(F.lit("events"), F.lit("users"), F.lit("unknown"))).alias("table"), F.lit("props").alias("column"))
    seen = lambda v: v["event_type"] != "view"
    manifest = [{"table": "events", "column": "props", "filter": seen, "validate": lambda v: F.length(v["props"]) > 7}, {"table": "users", "column": "props", "filter": seen, "validate": lambda v: v["event_type"] != "click"}]
    return fields.admitted(e, manifest).select(F.col("table").alias("field_of"), "event_id")


@query("""WITH w AS (SELECT user_id, floor(event_id * 37 / 250.0) AS f, max(event_id * 37) AS sent, CAST(max(event_id) AS VARCHAR) AS value FROM events GROUP BY 1, 2),
          b AS (SELECT *, sum(strlen(value)) OVER (PARTITION BY user_id, floor(sent / 1000.0) ORDER BY f) AS bytes FROM w) SELECT CAST(user_id AS VARCHAR) AS topic, sent, value FROM b WHERE bytes <= 9""")
def publisher_pace(c):
    e = c.scan("events").select(F.col("user_id").cast("string").alias("topic"), (F.col("event_id") * 37).alias("at"), F.col("event_id").cast("string").alias("value"))
    return fields.paced(e, 4, 9).withColumnRenamed("at", "sent")
