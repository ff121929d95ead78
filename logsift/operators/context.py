"""Context lines around matches: J1 (join form) and W2 (sliding-window form).

Both give the lines ``[n-C, n+C]`` of the same file, clipped to the file, with
``context_start = max(n-C, 1)``; C is clamped to 0..10.

J1 turns the range join into an equi-join: each match explodes to its 2C+1 line
keys, joined to the lines on ``(file_path, line_number)``.  The join key includes
the line number, so a hot file spreads over all tasks.  A match's own text and terms
travel with its own line's key, so one join and one grouping give the result; AQE
chooses the join from measured sizes.  Lines are cut into blocks of 2C+1, so a match and
its context touch two blocks at most; ``nearby_lines``, a filter over those blocks, drops
all other lines before the join, and what is shuffled is in proportion to the matches.

W2 uses a window over blocks of B lines per file instead of whole files; each
block also gets copies of the C lines on either side of it (the halo), so the
window sees every neighbour and a hot file is split into many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators.keyfilter import KeyFilter
from logsift.schemas import MAX_CONTEXT

DEFAULT_BLOCK_LINES = 1_000_000

def clamp_context(c: int) -> int:
    return max(0, min(int(c or 0), MAX_CONTEXT))


def nearby_lines(lines: DataFrame, matches: DataFrame, c: int) -> DataFrame:
    """The lines (``file_path, line_number, line``) in the blocks of 2C+1 lines that a match
    or its context touches, and a few others by chance."""
    c = clamp_context(c)
    size = 2 * c + 1
    block = lambda n: F.floor(n / F.lit(size)).cast("long")
    ends = F.explode(F.array_distinct(F.array(block(F.greatest(F.col("line_number") - c, F.lit(1))),
                                              block(F.col("line_number") + c))))
    wanted = KeyFilter(matches.select("file_path", ends.alias("_block")), ["file_path", "_block"])
    return wanted.keep(lines.select("file_path", "line_number", "line"), ["file_path", block(F.col("line_number"))])


def context_join(matches: DataFrame, lines: DataFrame, c: int) -> DataFrame:
    """Add ``context_lines`` (array) and ``context_start`` to matches."""
    c = clamp_context(c)
    if c == 0:
        return (matches.withColumn("context_lines", F.lit(None).cast("array<string>"))
                .withColumn("context_start", F.lit(None).cast("long")))
    own = F.col("line_number") == F.col("_m")
    keys = matches.select(
        "file_path", F.col("line_number").alias("_m"), "line_text", "matched_terms",
        F.explode(F.sequence(F.greatest(F.col("line_number") - c, F.lit(1)),
                             F.col("line_number") + c)).alias("line_number")) \
        .select("file_path", "_m", "line_number", F.when(own, F.col("line_text")).alias("_text"),
                F.when(own, F.col("matched_terms")).alias("_terms"))
    return (lines.select("file_path", "line_number", "line").join(keys, ["file_path", "line_number"])
            .groupBy("file_path", "_m")
            .agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("_ctx"),
                 F.first("_text", ignorenulls=True).alias("line_text"),
                 F.first("_terms", ignorenulls=True).alias("matched_terms"))
            .select("file_path", F.col("_m").alias("line_number"), "line_text", "matched_terms",
                    F.transform("_ctx", lambda s: s["line"]).alias("context_lines"),
                    F.greatest(F.col("_m") - c, F.lit(1)).cast("long").alias("context_start")))


def context_window(lines: DataFrame, c: int, block_lines: int = DEFAULT_BLOCK_LINES) -> DataFrame:
    """Every line with its ±C neighbours (``context_lines``, ``context_start``).
    Filter the result by a match predicate to get matches with context."""
    c = clamp_context(c)
    if block_lines <= 2 * c:
        raise ValueError("block_lines must exceed twice the context")
    base = lines.select("file_path", "line_number", "line").withColumns({
        "_blk": F.floor((F.col("line_number") - 1) / block_lines).cast("long"),
        "_off": F.pmod(F.col("line_number") - 1, F.lit(block_lines)),
    })
    home = base.withColumn("_home", F.lit(True))
    # the first C lines of a block also feed the block before, the last C the next
    prev_halo = (base.where((F.col("_off") < c) & (F.col("_blk") > 0))
                 .withColumn("_blk", F.col("_blk") - 1).withColumn("_home", F.lit(False)))
    next_halo = (base.where(F.col("_off") >= block_lines - c)
                 .withColumn("_blk", F.col("_blk") + 1).withColumn("_home", F.lit(False)))
    rows = home.unionByName(prev_halo).unionByName(next_halo) if c > 0 else home
    w = Window.partitionBy("file_path", "_blk").orderBy("line_number").rowsBetween(-c, c)
    return (rows.withColumn("context_lines", F.collect_list("line").over(w))
            .where("_home")
            .select("file_path", "line_number", "line", "context_lines",
                    F.greatest(F.col("line_number") - c, F.lit(1)).cast("long").alias("context_start")))
