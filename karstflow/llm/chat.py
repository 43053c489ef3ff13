"""Chat formatting: cumulative-snapshot collapse, then rendering.

A logged conversation is often a snapshot of a longer one. Every turn prefix gets a rolling hash:
the running XOR of position-tagged turn hashes (two 64-bit lanes). A conversation whose whole hash
is the proper-prefix hash of another is dropped by a left-anti join; of conversations with the
same turns the smallest id stays. What is left is rendered with a turn template.

Cases: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a fixed
order and repeated rows are turns of their own; a null role or text counts as empty and renders so;
a null conv_id is one conversation of its own and is kept last among equals; an empty table gives
no rows. Extra columns are not read. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text, the rolling hash (h1, h2) up to each turn, and whether it is the last."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    rows = rows.withColumns({"pos": F.row_number().over(order), "last": F.lead(F.lit(1)).over(order).isNull()})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lane = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), "pos", "role", "text")).over(running)
    return rows.withColumns({"h1": lane("first"), "h2": lane("second")}).drop("turn")


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no proper prefix or repeat of another."""
    key = ["pos", "h1", "h2"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("NOT last").select(*key).distinct()
    return whole.join(proper, key, "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def render(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """The text of each kept conversation: ``<|role|>`` line, the turn's text, ``<|end|>`` line."""
    turn = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n"))
    turns = prefixes.select(F.col("conv_id").alias("of"), "pos", turn.alias("line"))
    rows = turns.join(kept, F.col("of").eqNullSafe(F.col("conv_id")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(lines, "").alias("text"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with the same turns, itself included) and the
    rendered text of every maximal conversation of ``turns`` (conv_id, turn, role, text)."""
    prefixes = turn_prefixes(turns)
    return render(prefixes, maximal(prefixes))
