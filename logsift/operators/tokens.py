"""Token index (A8), file lookup by keywords (A11, U2, U3), index replacement
(J4) and stale-file detection (J5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.fixed import TOKEN_MIN_BYTES
from logsift.functions.text import explode_fields, strip_token
from logsift.sources.tables import DOC_CHUNK_LINES, parts_of


def file_keywords(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """``file_path, keyword`` -- distinct tokens per file: whitespace split,
    punctuation stripped at both ends, lower-cased, at least 3 bytes long.
    The distinct is a partial + final aggregate, so a hot file is deduplicated
    map-side before the shuffle.

    With ``parts`` (``index_parts``) the lines are dealt by chunks of their files first, so that
    no task tells apart the tokens of more than its part of them, whatever the size of a
    scan's split, and the tokens are dealt into as many parts."""
    tok = F.lower(strip_token(F.col("_t"))).alias("keyword")
    long_enough = F.octet_length("keyword") >= TOKEN_MIN_BYTES
    if parts is None:
        return explode_fields(lines, "line", ["file_path"], "_t").select("file_path", tok).where(long_enough).distinct()
    chunk = F.floor(F.col("line_number") / DOC_CHUNK_LINES).alias("_chunk")
    dealt = lines.select("file_path", chunk, "line").repartition(parts, "file_path", "_chunk")
    # rows of a chunk are in one task already: no shuffle
    once = explode_fields(dealt, "line", ["file_path", "_chunk"], "_t").select("file_path", "_chunk", tok) \
        .where(long_enough).distinct()
    return once.select("file_path", "keyword").repartition(parts, "file_path", "keyword").distinct()


def index_parts(lines: DataFrame) -> int:
    """Parts in which the tokens of ``lines`` are told apart: it grows with their bytes."""
    return parts_of(lines, "line")


def _keys(keywords) -> list[str]:
    return list(dict.fromkeys(k.lower() for k in keywords))


def files_for_keywords(index: DataFrame, keywords, mode: str = "OR") -> DataFrame:
    """Files holding the exact tokens: any of them for OR, all for every
    other mode.  ``isin`` reaches the Parquet scan (and its bloom filter)."""
    keys = _keys(keywords)
    hit = index.where(F.col("keyword").isin(keys))
    if mode == "OR":
        return hit.select("file_path").distinct()
    return (hit.groupBy("file_path").agg(F.count_distinct("keyword").alias("_n"))
            .where(F.col("_n") == len(keys)).select("file_path"))


def files_union(index: DataFrame, keywords) -> DataFrame:
    """Union distinct of the per-keyword file lists."""
    parts = [index.where(F.col("keyword") == k).select("file_path") for k in _keys(keywords)]
    return reduce(DataFrame.union, parts).distinct()


def files_intersect(index: DataFrame, keywords) -> DataFrame:
    """Intersection of the per-keyword file lists."""
    parts = [index.where(F.col("keyword") == k).select("file_path") for k in _keys(keywords)]
    return reduce(DataFrame.intersect, parts)


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Drop every row of the replaced ``files`` (default: those present in ``new``),
    then add ``new``.  Pass ``files`` when a replaced file may have no rows any more."""
    files = new.select("file_path") if files is None else files.select("file_path")
    return old.join(files.distinct(), "file_path", "left_anti").unionByName(new)


def stale_files(inventory: DataFrame, built: DataFrame) -> DataFrame:
    """Files never indexed or changed after their index was built.
    ``inventory``: ``file_path, modified``; ``built``: ``file_path, built_at``."""
    return (inventory.join(built, "file_path", "left")
            .where(F.col("built_at").isNull() | (F.col("modified") > F.col("built_at")))
            .select("file_path", "modified", "built_at"))


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> str:
    """SNK7: store the index range-partitioned and sorted by keyword and file (a keyword of
    very many files is spread over tasks), with a Parquet bloom filter on ``keyword`` so
    lookups skip row groups and files."""
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (index.repartitionByRange(n, "keyword", "file_path").sortWithinPartitions("keyword", "file_path")
     .write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#keyword", "true")
     .parquet(path))
    return path
