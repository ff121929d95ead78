"""Chat formatting (operator 9): cumulative snapshots are collapsed, then rendered.

A log often holds a conversation several times, each time some turns longer.  Rolling
hashes of every turn prefix tell which conversations are prefixes of longer ones;
anti-joins keep the longest, and their turns are rendered.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import stage

SPAN = 1024  # turn numbers of a block: no window holds more of a conversation's numbers
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _blank(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn with its place, its conversation's length and two 64-bit hashes of the
    prefix that ends with it: (conv_id, block, place, n_turns, role, text, h1, h2).

    A turn's hash covers place, role and text, and a prefix's is their exclusive or, so it
    rolls along in a window; blocks of SPAN turn numbers are joined by their totals."""
    rows = conversations.select(
        "conv_id", "turn", F.lower(F.trim(_blank("role"))).alias("role"), _blank("text").alias("text")) \
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-1).cast("long")))
    key = ["conv_id", "block"]
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)

    def totals(of: DataFrame, aggs: dict, ends) -> DataFrame:
        """Per block: what the blocks before it hold."""
        return of.groupBy(*key).agg(*[v.alias(k) for k, v in aggs.items()]).select(*key, *ends)

    counts = totals(rows, {"n": F.count(F.lit(1))}, [
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(every).alias("n_turns")])
    same = lambda d: [F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")), F.col("l.block") == F.col("r.block")]
    placed = (rows.withColumn("in_block", F.row_number().over(order)).alias("l").join(counts.alias("r"), same(0))
              .select("l.*", (F.col("in_block") + F.col("offset")).alias("place"), "n_turns"))
    placed = placed.withColumn("t1", F.xxhash64(F.lit(1), "place", "role", "text")) \
        .withColumn("t2", F.xxhash64(F.lit(2), "text", "place", "role"))
    sums = totals(placed, {"x1": F.bit_xor("t1"), "x2": F.bit_xor("t2")}, [
        F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(f"before{c[1]}") for c in ("x1", "x2")])
    return (placed.withColumn("p1", F.bit_xor("t1").over(so_far)).withColumn("p2", F.bit_xor("t2").over(so_far))
            .alias("l").join(sums.alias("r"), same(0))
            .select("l.conv_id", "l.block", "place", "n_turns", "role", "text",
                    F.col("p1").bitwiseXOR(F.col("before1")).alias("h1"),
                    F.col("p2").bitwiseXOR(F.col("before2")).alias("h2")))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, kept, kept_as) of every conversation: ``kept`` for one, the least
    id, of each distinct conversation that is no prefix of a longer one; ``kept_as`` is the
    kept conversation that stands for it: the longest that it is a prefix of, of these the
    one of least id."""
    hashes = ["h1", "h2"]
    whole = turns.where("place = n_turns").select("conv_id", "n_turns", *hashes)
    inner = turns.where("place < n_turns and conv_id is not null").select(  # a null id is never kept
        F.col("place").alias("n_turns"), *hashes).distinct()
    distinct = whole.groupBy("n_turns", *hashes).agg(F.min("conv_id").alias("least"))
    longest = distinct.join(inner, ["n_turns", *hashes], "left_anti")
    kept = longest.select(F.col("least").alias("conv_id"))
    stands = (turns.join(kept, "conv_id")  # every prefix of a kept conversation, itself included
              .groupBy(F.col("place").alias("n_turns"), *hashes)
              .agg(F.min(F.struct((-F.col("n_turns")).alias("n"), "conv_id")).alias("best")))
    return (whole.join(stands, ["n_turns", *hashes], "left")
            .select("conv_id", "n_turns", F.col("conv_id").eqNullSafe(F.col("best.conv_id")).alias("kept"),
                    F.col("best.conv_id").alias("kept_as")))


def rendered(role: Column, text: Column) -> Column:
    """A turn in the chat template; template marks inside its text are broken up."""
    safe = F.replace(F.replace(text, F.lit(OPEN), F.lit("< |im_start| >")), F.lit(CLOSE), F.lit("< |im_end| >"))
    return F.concat(F.lit(OPEN), role, F.lit("\n"), safe, F.lit(CLOSE + "\n"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn of every conversation: conv_id, place (from 1), n_turns, kept,
    kept_as, role, is_target (an assistant's turn in a kept conversation), rendered (null
    unless kept).  A kept conversation's text is its rendered turns in order of place; turns
    stay rows, so no conversation is gathered whole.

    Turns are ordered by turn, role and text, null turns first; null role or text counts as
    empty and roles are trimmed and lower-cased; repeated turns stay; a null conv_id is a
    conversation of its own, never kept (its kept_as is null); an empty table gives no rows.
    Other columns are not read."""
    turns = stage(prefixes(conversations), "turns")
    fate = collapse(turns)
    return (turns.join(fate.drop("n_turns"), "conv_id", "left")
            .select("conv_id", "place", "n_turns", F.coalesce("kept", F.lit(False)).alias("kept"), "kept_as", "role",
                    (F.coalesce("kept", F.lit(False)) & (F.col("role") == "assistant")).alias("is_target"),
                    F.when(F.col("kept"), rendered(F.col("role"), F.col("text"))).alias("rendered")))


SQL = """
WITH t AS (
  SELECT conv_id, lower(trim(coalesce(role, ''))) AS role, coalesce(text, '') AS text,
         row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, lower(trim(coalesce(role, ''))), coalesce(text, ''))
), p AS (
  SELECT *, list(role || chr(31) || text) OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM t
), whole AS (SELECT conv_id, n_turns, prefix FROM p WHERE place = n_turns AND conv_id IS NOT NULL),
longest AS (
  SELECT min(conv_id) AS conv_id FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.conv_id IS NOT NULL AND p.prefix = w.prefix)
  GROUP BY prefix
), stands AS (
  SELECT prefix, arg_min(conv_id, struct_pack(a := -n_turns, b := conv_id)) AS kept_as
  FROM p WHERE conv_id IN (SELECT conv_id FROM longest) GROUP BY prefix
), fate AS (
  SELECT w.conv_id, s.kept_as, w.conv_id = s.kept_as AS kept FROM whole w JOIN stands s ON w.prefix = s.prefix
)
SELECT t.conv_id, t.place, t.n_turns, coalesce(f.kept, false) AS kept, f.kept_as, t.role,
       coalesce(f.kept, false) AND t.role = 'assistant' AS is_target,
       CASE WHEN f.kept THEN '<|im_start|>' || t.role || chr(10)
            || replace(replace(t.text, '<|im_start|>', '< |im_start| >'), '<|im_end|>', '< |im_end| >')
            || '<|im_end|>' || chr(10) END AS rendered
FROM t LEFT JOIN fate f ON t.conv_id = f.conv_id
"""
