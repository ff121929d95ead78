"""Minute index (W3) and start-line lookup.

W3 keeps a line whenever its minute differs from the previous line *that has a
minute* in the same file.  ``lag`` over a whole file would put a hot file in one
task, so files are cut into blocks of B lines: ``lag`` runs per block, and the
first row of a block takes the last minute of the nearest earlier block from a
small per-block table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.text import line_minute
from logsift.operators.keyfilter import BROADCAST_BYTES, measured_bytes
from logsift.session import materialize

DEFAULT_BLOCK_LINES = 1_000_000
LISTED_STARTS = 200  # files whose start lines are sent to the scan as a predicate

from logsift.fixed import SEEK_MARGIN  # noqa: E402


def minute_index(lines: DataFrame, block_lines: int = DEFAULT_BLOCK_LINES) -> DataFrame:
    """``file_path, minute, line_number`` -- one row per run of a minute."""
    m = (lines.select("file_path", "line_number", line_minute(F.col("line")).alias("minute"))
         .where(F.col("minute").isNotNull())
         .withColumn("_blk", F.floor((F.col("line_number") - 1) / block_lines).cast("long")))
    # last minute of each block: pack (line, minute) into one long so the max is a
    # hash aggregate (a string max_by would sort every row)
    code = (F.substring("minute", 1, 2).cast("long") * 100 + F.substring("minute", 4, 2).cast("long"))
    packed = F.max(F.col("line_number") * 10000 + code)
    last = (m.groupBy("file_path", "_blk").agg(packed.alias("_p"))
            .select("file_path", "_blk",
                    F.format_string("%02d:%02d", (F.pmod("_p", F.lit(10000)) / 100).cast("int"),
                                    F.pmod("_p", F.lit(100)).cast("int")).alias("_last")))
    carry = last.select(
        "file_path", "_blk",
        F.lag("_last").over(Window.partitionBy("file_path").orderBy("_blk")).alias("_carry"))
    w = Window.partitionBy("file_path", "_blk").orderBy("line_number")
    return (m.join(carry, ["file_path", "_blk"])
            .withColumn("_prev", F.coalesce(F.lag("minute").over(w), F.col("_carry")))
            .where(F.col("_prev").isNull() | (F.col("_prev") != F.col("minute")))
            .select("file_path", "minute", "line_number"))


def seek_line(index: DataFrame, start_time: str, files: DataFrame | None = None,
              margin: int = SEEK_MARGIN) -> DataFrame:
    """Per file, the line of the last entry before the first entry whose
    minute is after ``start_time`` (the last entry if none is after), minus
    ``margin`` (1000), floored at 0.  An empty time or a file without entries gives 0.
    ``files`` (``file_path``) lists files to report even without entries."""
    if files is None:
        files = index.select("file_path").distinct()
    t = (start_time or "").strip()[:5]
    if not t:
        return files.select("file_path", F.lit(0).cast("long").alias("start_line"))
    first_after = index.groupBy("file_path").agg(
        F.min(F.when(F.col("minute") > t, F.col("line_number"))).alias("_gt"))
    found = (index.join(first_after, "file_path")
             .groupBy("file_path")
             .agg(F.max(F.when(F.col("_gt").isNull() | (F.col("line_number") < F.col("_gt")),
                               F.col("line_number"))).alias("_r")))
    return (files.join(found, "file_path", "left")
            .select("file_path",
                    F.greatest(F.coalesce(F.col("_r"), F.lit(0)) - margin, F.lit(0))
                    .cast("long").alias("start_line")))


def lines_from(lines: DataFrame, index: DataFrame, start_time: str, margin: int = SEEK_MARGIN,
               most: int = LISTED_STARTS) -> DataFrame:
    """J6 used by a search: the lines from each file's start line on; a file without entries
    is read whole.

    Start lines above 0 are staged.  For up to ``most`` files they become a predicate on
    ``file_path`` and ``line_number`` that reaches the Parquet scan, so row groups before a
    start are not read; beyond that they are joined, broadcast below a bound."""
    starts = materialize(seek_line(index, start_time, margin=margin).where("start_line > 0"), "start-lines")
    if starts.count() <= most:
        for r in starts.collect():
            lines = lines.where((F.col("file_path") != r["file_path"]) | (F.col("line_number") >= r["start_line"]))
        return lines
    small = F.broadcast(starts) if measured_bytes(starts) <= BROADCAST_BYTES else starts
    return (lines.join(small, "file_path", "left").where(F.col("line_number") >= F.coalesce("start_line", F.lit(0)))
            .select(*lines.columns))
