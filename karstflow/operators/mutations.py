"""Row changes as joins: insert, upsert, update, delete, and what a delete takes along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import RequestError, TableSpec


def validate(rows: DataFrame, spec: TableSpec) -> None:
    if odd := [c for c in rows.columns if c not in spec.columns]:
        raise RequestError(f"{spec.name} has no columns {odd}")
    if missing := [c for c in spec.primary_key if c not in rows.columns]:
        raise RequestError(f"{spec.name}: the key columns {missing} are missing")


def once(rows: DataFrame, spec: TableSpec, order: str | None, last: bool) -> DataFrame:
    """One row for each key: the first or last in ``order``, a column beside the table's own; without one the
    rows count in the order of their values. The sum by key leaves rows where the join by key needs them."""
    validate(rows.drop(order) if order else rows, spec)
    pk, given = list(spec.primary_key), [c for c in rows.columns if c in spec.columns and c not in spec.primary_key]
    if not given:
        return rows.select(*pk).distinct()
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*pk).agg(pick(F.struct(*given), F.col(order) if order else F.struct(*given)).alias("row")).select(*pk, "row.*")


def insert(table: DataFrame, rows: DataFrame, spec: TableSpec, order: str | None = None) -> DataFrame:
    """New keys are added; rows whose key exists are ignored, and of rows with one new key all but the first."""
    rows = once(rows, spec, order, last=False)
    return table.unionByName(rows.join(table.select(*spec.primary_key), list(spec.primary_key), "left_anti"), allowMissingColumns=True).select(*table.columns)


def upsert(table: DataFrame, rows: DataFrame, spec: TableSpec, order: str | None = None) -> DataFrame:
    """New keys are added; of existing rows the supplied columns are set, the others stay. Of rows with one key the last counts."""
    rows = once(rows, spec, order, last=True)
    pk = list(spec.primary_key)
    given = [c for c in rows.columns if c not in pk]
    new = rows.select(*pk, F.lit(True).alias("supplied"), *(F.col(c).alias(f"new_{c}") for c in given))
    both = table.join(new, pk, "full")
    return both.select(*(F.when(F.col("supplied"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns))


def update(table: DataFrame, rows: DataFrame, spec: TableSpec, order: str | None = None) -> DataFrame:
    """The supplied columns of existing rows are set; unknown keys are ignored. Of rows with one key the last counts."""
    rows = once(rows, spec, order, last=True)
    pk = list(spec.primary_key)
    given = [c for c in rows.columns if c not in pk]
    if not given:
        return table
    new = rows.select(*pk, F.lit(True).alias("supplied"), *(F.col(c).alias(f"new_{c}") for c in given))
    both = table.join(new, pk, "left")
    return both.select(*(F.when(F.col("supplied"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns))


def delete(table: DataFrame, keys: DataFrame, spec: TableSpec) -> DataFrame:
    validate(keys, spec)
    return table.join(keys.select(*spec.primary_key), list(spec.primary_key), "left_anti")


@dataclass(frozen=True)
class ForeignKey:
    """``child.columns`` refer to ``parent.parent_columns``; on_delete: cascade or set null (others are not enforced)."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str


def expand_delete(target: str, doomed: DataFrame, tables: dict[str, DataFrame], keys: list[ForeignKey], depth: int = 32) -> list[tuple[str, str, DataFrame, tuple[str, ...]]]:
    """(action, table, rows, columns) of a delete, children before parents: rows to delete, or rows whose
    referring columns become NULL. Each step is a semi join; a table already on the path ends it."""
    out: list[tuple[str, str, DataFrame, tuple[str, ...]]] = []

    def visit(table: str, rows: DataFrame, path: tuple[str, ...]) -> None:
        if len(path) > depth:
            raise RequestError("the foreign keys are nested too deeply")
        for k in keys:
            if k.parent != table or k.on_delete not in ("cascade", "set null") or k.child in path:
                continue
            refs = rows.select(*(F.col(p).alias(c) for p, c in zip(k.parent_columns, k.columns))).dropna().distinct()
            hit = tables[k.child].join(refs, list(k.columns), "left_semi").select(*tables[k.child].columns)
            if k.on_delete == "cascade":
                visit(k.child, hit, (*path, k.child))
            else:
                out.append(("set null", k.child, hit, k.columns))
        out.append(("delete", table, rows, ()))

    visit(target, doomed, (target,))
    return out


def check_write_set(returned: DataFrame, declared: DataFrame, pk: list[str]) -> DataFrame:
    """The keys that only one side has, with the side; empty if a write touched exactly what it declared."""
    both = returned.select(*pk, F.lit(1).alias("n")).union(declared.select(*pk, F.lit(-1).alias("n")))
    odd = both.groupBy(*pk).agg(F.sum("n").alias("n")).where("n <> 0")
    return odd.select(*pk, F.when(F.col("n") > 0, "undeclared").otherwise("unwritten").alias("problem"))


def preflight(mutations: DataFrame, clients: DataFrame) -> DataFrame:
    """Each mutation (client, id, user) against its client's last id: replay, apply, gap, or forbidden.

    A client's ids apply as long as they follow on without a gap; the first gap refuses the rest."""
    order = Window.partitionBy("client").orderBy("id")
    rows = mutations.join(clients.select("client", "last_id", F.col("user").alias("owner")), "client", "left")
    rows = rows.withColumn("base", F.coalesce("last_id", F.lit(0)))
    new = rows.where(F.col("id") > F.col("base")).withColumn("want", F.col("base") + F.row_number().over(order))
    old = rows.where(F.col("id") <= F.col("base")).withColumn("want", F.lit(None).cast("long"))
    verdict = F.when(F.col("owner").isNotNull() & (F.col("owner") != F.col("user")), "forbidden").when(F.col("want").isNull(), "replay").when(F.col("id") == F.col("want"), "apply").otherwise("gap")
    return new.unionByName(old).select("client", "id", verdict.alias("verdict"))


def check_pushes(pushes: DataFrame, dropped: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(mutations, problems) of push bodies (push, version, client, id, name): a body with any problem goes as a
    whole. A body's version must be 1, each mutation needs a client, a positive id and a name, and a client's ids
    must not repeat. Mutations named in ``dropped`` (clean-up without effects) are left out of good bodies."""
    broken = F.col("client").isNull() | F.col("id").isNull() | (F.col("id") <= 0) | F.col("name").isNull()
    rows = pushes.groupBy("push", "client", "id").agg(F.max(F.coalesce(F.col("version") != 1, F.lit(True))).alias("unsupported"), F.max(broken).alias("broken"), (F.count("*") > 1).alias("repeats"))
    bodies = rows.groupBy("push").agg(*(F.max(c).alias(c) for c in ("unsupported", "broken", "repeats")))
    problem = F.when(F.col("unsupported"), "unsupported version").when(F.col("broken"), "malformed mutation").when(F.col("repeats"), "repeated id")
    problems = bodies.select("push", problem.alias("problem")).where("problem IS NOT NULL")
    good = pushes.join(problems.select("push"), "push", "left_anti").where(~F.col("name").isin(*dropped) if dropped else F.lit(True))
    return good.select("push", "client", "id", "name"), problems


def run_mutations(verdicts: DataFrame, failed: DataFrame, effects: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(effects, clients) after the mutations (client, id, verdict) that apply: one that failed in the application
    leaves no effect, and its client's last id moves on all the same."""
    ran = verdicts.where("verdict = 'apply'").select("client", "id")
    good = ran.join(failed.select("client", "id"), ["client", "id"], "left_anti")
    return effects.join(good, ["client", "id"], "left_semi"), settle_acks(ran, clients)


def settle_in_order(mutations: DataFrame, acks: DataFrame, clients: DataFrame) -> DataFrame:
    """``settle_acks`` where the acks (seq, client, id) are the mutations exactly, in their order; else no id moves."""
    both = mutations.select("seq", F.struct("client", "id").alias("sent")).join(acks.select("seq", F.struct("client", "id").alias("acked")), "seq", "full")
    if not both.where(~F.col("sent").eqNullSafe(F.col("acked"))).isEmpty():
        raise RequestError("the acknowledgements differ from the mutations")
    return settle_acks(acks, clients)


def settle_acks(acks: DataFrame, clients: DataFrame) -> DataFrame:
    """Each client's last id after acknowledged mutations: the largest id, never lower than before."""
    top = acks.groupBy("client").agg(F.max("id").alias("ack"))
    return clients.join(top, "client", "full").select("client", F.greatest(F.coalesce("last_id", F.lit(0)), F.coalesce("ack", F.lit(0))).alias("last_id"))
