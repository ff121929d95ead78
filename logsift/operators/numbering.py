"""Row numbering that survives a hot group (W1 / SRC3).

``row_number() OVER (PARTITION BY file ORDER BY ...)`` sends every row of a file
to one task; if one file holds a third of all lines, one task sorts a third of the
data.  Here the rows are range-partitioned on ``(group, order...)`` instead, so a
hot group is split over many tasks.  Each task tags its rows with their position;
a small per-(task, group) table of row counts, prefix-summed per group, gives every
segment its offset.  The tagged rows are written once to the shared work folder
first, so both reads see the same tags even if an executor is lost.

The small table is staged and measured, and broadcast below a bound, so the rows are
shuffled once, by the range partitioning.  Beyond the bound Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.operators.keyfilter import small_side
from logsift.session import materialize

_PART, _POS, _FIRST, _BEFORE = "_seg_part", "_seg_pos", "_seg_first", "_seg_before"


def _segment_offsets(tagged: DataFrame, group_cols: list[str]) -> DataFrame:
    """(task, group) → first position in that task and rows of the group in
    earlier tasks.  At most tasks + groups rows."""
    segs = tagged.groupBy(_PART, *group_cols).agg(
        F.min(_POS).alias(_FIRST), F.count(F.lit(1)).alias("_seg_rows"))
    w = Window.partitionBy(*group_cols).orderBy(_PART).rowsBetween(
        Window.unboundedPreceding, -1)
    return segs.withColumn(
        _BEFORE, F.coalesce(F.sum("_seg_rows").over(w), F.lit(0))).drop("_seg_rows")


def number_rows(df: DataFrame, order_cols: list, group_cols: list[str] = (),
                out_col: str = "line_number", partitions: int | None = None,
                staging: str | None = None, strategy: str = "range") -> DataFrame:
    """Add ``out_col`` = 1-based rank of each row within ``group_cols`` by
    ``order_cols`` (names or sort Columns such as ``col.desc()``).  ``order_cols``
    must make rows unique within a group and group keys must not be null.
    ``staging`` names the folder for the tagged rows (the caller may delete it
    once the result is written).

    ``strategy``: ``range`` (default) splits groups over tasks at every size;
    ``window`` is a plain ``row_number()`` per group, for callers that know their
    groups are bounded."""
    spark = df.sparkSession
    group_cols = list(group_cols)
    keys = [*group_cols, *order_cols]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if strategy == "window" and group_cols:
        # range (not hash) on the group keys: each task holds a contiguous run of
        # groups, so a day-partitioned write gets few files per day; it also
        # satisfies the window's clustering, so no second shuffle
        w = Window.partitionBy(*group_cols).orderBy(*order_cols)
        return df.repartitionByRange(n, *group_cols).withColumn(
            out_col, F.row_number().over(w).cast("long"))
    tagged = materialize(df.repartitionByRange(n, *keys)
                         .sortWithinPartitions(*keys)
                         .withColumn(_PART, F.spark_partition_id())
                         .withColumn(_POS, F.monotonically_increasing_id()), "numbered", staging)
    segs = small_side(_segment_offsets(tagged, group_cols), "segments")
    return (tagged.join(segs, [_PART, *group_cols])
            .withColumn(out_col, F.col(_POS) - F.col(_FIRST) + F.col(_BEFORE) + 1)
            .drop(_PART, _POS, _FIRST, _BEFORE))


def number_contiguous(tagged: DataFrame, group_col: str, pos_col: str,
                      out_col: str = "line_number") -> DataFrame:
    """Numbering when each group's rows are already contiguous and in order in
    one task, as for an unsplittable gzip file: ``pos - min(pos) + 1``.  The
    per-group minimum is a small aggregate, staged, measured and broadcast below a bound;
    no shuffle of the rows there."""
    firsts = small_side(tagged.groupBy(group_col).agg(F.min(pos_col).alias(_FIRST)), "first-positions")
    return (tagged.join(firsts, group_col)
            .withColumn(out_col, F.col(pos_col) - F.col(_FIRST) + 1)
            .drop(_FIRST, pos_col))
