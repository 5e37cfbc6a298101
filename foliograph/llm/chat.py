"""Chat formatting: collapse cumulative snapshots of conversations, then render them.

A logged conversation whose turns begin a longer one is a snapshot of it. Each turn is
hashed with its number, role and text; the exclusive or of the hashes up to a turn names
that prefix (128 bits, with the count of turns). A conversation whose name is the name
of a strict prefix of any other goes, by an anti-join; of equal ones the smallest conv_id
stays. Only DataFrame functions.

Up to there only hashes travel; texts are read again, each once, for what is rendered.
Turns are dealt in blocks of BLOCK numbers, and those of one number by the upper bits of
their hashes, so a conversation that holds a third of all turns takes many tasks even if
all its turns have one number: what blocks hold is summed first, and running sums join
outer and inner ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_join

#: Turn numbers in a block, and turns in a rendered part.
BLOCK = 64
#: A turn in a table of distinct turns: conversation, number and two hashes.
TURN = ["conv_id", "turn", "x", "y"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, x, y, role, text); null turns are -1, null role and text empty,
    rows without conv_id left out."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), plain("role"), plain("text")).where("conv_id is not null")
    return rows.select("conv_id", "turn", F.xxhash64("turn", "role", "text").alias("x"), F.xxhash64(F.lit("second"), "text", "role", "turn").alias("y"), "role", "text")


def prefix_names(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, x, y, n, name_x, name_y, length) of each distinct turn: its place
    and the name of the prefix it ends. Turns of one number stand in order of x and y."""
    outer, inner = ["conv_id", "block"], ["conv_id", "block", "turn", "deal"]
    dealt = turns.select(*TURN).distinct().withColumns({"block": F.floor(F.col("turn") / block), "deal": F.shiftright("x", 56)})
    sums = {"n": F.sum, "x": F.bit_xor, "y": F.bit_xor}

    def before(w: Window, tag: str) -> list[Column]:
        w = w.rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(f(c).over(w), F.lit(0)).alias(f"{c}{tag}") for c, f in sums.items()]

    cells = dealt.groupBy(*inner).agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = cells.groupBy(*outer).agg(*[f(c).alias(c) for c, f in sums.items()])
    far = blocks.select(*outer, *before(Window.partitionBy("conv_id").orderBy("block"), "0"), F.sum("n").over(Window.partitionBy("conv_id")).alias("length"))
    near = cells.select(*inner, *before(Window.partitionBy(*outer).orderBy("turn", "deal"), "1")).join(far, outer)
    own = Window.partitionBy(*inner).orderBy("x", "y").rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.select("*", F.count("*").over(own).alias("n"), F.bit_xor("x").over(own).alias("own_x"), F.bit_xor("y").over(own).alias("own_y"))
    both = running.join(near, inner)
    name = {c: F.col(f"own_{c}").bitwiseXOR(F.col(f"{c}0")).bitwiseXOR(F.col(f"{c}1")).alias(f"name_{c}") for c in "xy"}
    return both.select(*TURN, (F.col("n") + F.col("n0") + F.col("n1")).alias("n"), name["x"], name["y"], "length")


def maximal_conversations(names: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that begin no longer one."""
    key = ["n", "name_x", "name_y"]
    whole = names.where("n = length").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = names.where("n < length").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def rendered(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, n_chars, rendered) of each maximal conversation.

    A part holds ``block`` turns, in order, between chat markers; the parts of a
    conversation one after the other are its rendering, so a very long conversation is
    many rows. Rows given twice count once, rows without conv_id belong to no
    conversation, a null turn is number -1, turns with one number stand in order of their
    hashes, and an empty table gives no rows.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = turns_of(conversations)
    names = scratch.save(prefix_names(turns, block), "names")
    kept = scratch.save(maximal_conversations(names), "kept")
    places = hot_join(names.select(*TURN, "n"), kept, "conv_id", "n_turns", "x").select(*TURN, "n")
    once = turns.groupBy(*TURN).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    told = places.join(once, TURN).groupBy("conv_id", F.floor((F.col("n") - 1) / block).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "role", "text"))).alias("x"))
    text = F.array_join(F.transform("x", lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n"))), "")
    return told.select("conv_id", "part", F.size("x").cast("long").alias("n_turns"), F.length(text).cast("long").alias("n_chars"), text.alias("rendered"))


RENDERED_SQL = """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), whole AS (SELECT conv_id, string_agg(turn || chr(1) || role || chr(2) || text || chr(3), '' ORDER BY turn, role, text) AS s FROM t GROUP BY conv_id
), kept AS (SELECT min(conv_id) AS conv_id, s FROM whole GROUP BY s
), maximal AS (SELECT conv_id FROM kept k WHERE NOT EXISTS (SELECT 1 FROM kept o WHERE length(o.s) > length(k.s) AND starts_with(o.s, k.s))
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM t JOIN maximal USING (conv_id)
), parts AS (
  SELECT conv_id, CAST((n - 1) // 64 AS BIGINT) AS part, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM numbered GROUP BY ALL
)
SELECT conv_id, part, n_turns, length(rendered) AS n_chars, rendered FROM parts
"""
