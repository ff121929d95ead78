"""Stored results, pages and exports (SNK1-SNK6, SL3, FN12).

A search's matches are stored once, numbered in search order (``result_no``,
1-based, by the skew-safe global numbering), under ``root/matches/query_key=K``
with a one-row summary under ``root/summary/query_key=K``.  Pages are then a
range filter on ``result_no`` -- pushed to Parquet -- at any depth.  Exports
write through Spark's distributed writers; a folder of parts replaces the
reference's single file."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import base_name, ceil_div
from logsift.operators.numbering import number_rows
from logsift.operators.search import search, search_totals
from logsift.schemas import SearchSpec
from logsift.session import path_exists

from logsift.fixed import (  # noqa: E402
    CSV_HEADER, PAGE_SIZE_DEFAULT, PAGE_SIZE_MAX, REPORT_ENTRY, REPORT_HEADER)


def query_key(spec: SearchSpec, files: Column, size: Column) -> Column:
    """FN12: SHA-256 of every search field except the request id, plus the state
    of the files searched (count and bytes), so changed files give a new key."""
    return F.sha2(F.concat(F.lit(spec.canonical_json()), F.lit("|"), files.cast("string"),
                           F.lit("|"), size.cast("string")), 256)


def result_summary(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """``query_key, total_matches, total_files, searched_size`` of a search."""
    t = search_totals(lines, spec)
    total = F.least(F.col("matches_found"), F.lit(spec.max_matches)) if spec.max_matches > 0 \
        else F.col("matches_found")
    return t.select(query_key(spec, F.col("files_total"), F.col("searched_size")).alias("query_key"),
                    total.alias("total_matches"),
                    F.col("files_total").alias("total_files"), "searched_size")


def numbered_matches(matches: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matches with ``result_no`` in search order (files ascending, or descending
    for ``latest``; lines ascending)."""
    fp = F.col("file_path").desc() if spec.search_order == "latest" else F.col("file_path").asc()
    return number_rows(matches, [fp, F.col("line_number").asc()], [], out_col="result_no")


def stored_key(lines: DataFrame, spec: SearchSpec, source: str | None = None) -> str:
    """Key of a stored result: the search's fields and the state of what it searched.

    ``source``: a digest of the source (``session.path_state``: names, sizes, times), so no
    line is read to find a stored result.  Without one the lines themselves are digested."""
    if source is None:
        row = lines.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file_path", "line_number", "line"))).first()
        source = f"{row[0]}|{row[1]}"
    return hashlib.sha256(f"{spec.canonical_json()}|{source}".encode()).hexdigest()


def store_results(lines: DataFrame, spec: SearchSpec, root: str, source: str | None = None) -> str:
    """SNK1: run the search once and store matches + summary; return the key.
    A stored key is reused (repeat searches read the stored rows)."""
    key = stored_key(lines, spec, source)
    mdir, sdir = f"{root}/matches/query_key={key}", f"{root}/summary/query_key={key}"
    if path_exists(lines.sparkSession, f"{sdir}/_SUCCESS"):
        return key
    summary = result_summary(lines, spec).collect()[0]
    (numbered_matches(search(lines, spec), spec)
     .sortWithinPartitions("result_no").write.mode("overwrite").parquet(mdir))
    lines.sparkSession.createDataFrame(
        [(summary["total_matches"], summary["total_files"], summary["searched_size"])],
        "total_matches long, total_files long, searched_size long").coalesce(1) \
        .write.mode("overwrite").parquet(sdir)
    return key


def write_match_records(matches: DataFrame, path: str) -> str:
    """SNK1 in the reference's record format: one JSON object per match
    (``file_path, line_number, line_text, matched_terms[, context_lines,
    context_start]``), readable with ``sources.stored.read_match_records``."""
    cols = [c for c in ("file_path", "line_number", "line_text", "matched_terms",
                        "context_lines", "context_start") if c in matches.columns]
    matches.select(*cols).write.mode("overwrite").json(path)
    return path


def stored_matches(spark: SparkSession, root: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/matches/query_key={key}")  # its own columns, no other result's


def stored_summary(spark: SparkSession, root: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root}/summary/query_key={key}").withColumn("query_key", F.lit(key))


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """SL3: page at least 1; size 25 when < 1, at most 500."""
    page = page if page >= 1 else 1
    size = page_size if page_size >= 1 else PAGE_SIZE_DEFAULT
    return page, min(size, PAGE_SIZE_MAX)


def page_of(numbered: DataFrame, page: int, page_size: int) -> DataFrame:
    """SL3: the rows of one page of a numbered result."""
    page, size = page_bounds(page, page_size)
    lo = (page - 1) * size
    return numbered.where((F.col("result_no") > lo) & (F.col("result_no") <= lo + size))


def total_pages(total: Column, page_size: int) -> Column:
    _, size = page_bounds(1, page_size)
    return F.greatest(ceil_div(total, F.lit(size)), F.lit(1))


# Quotes are doubled and blanks kept, as CSV readers expect.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def in_order(matches: DataFrame) -> DataFrame:
    """Matches laid out in search order over the written parts, where they are numbered."""
    if "result_no" not in matches.columns:
        return matches
    return matches.repartitionByRange("result_no").sortWithinPartitions("result_no")


def export_rows(matches: DataFrame) -> DataFrame:
    """SNK2 rows: base file name, line number, terms joined by ``|``, the line."""
    file_, number, terms, message = CSV_HEADER
    return matches.select(base_name(F.col("file_path")).alias(file_),
                          F.col("line_number").alias(number),
                          F.concat_ws("|", "matched_terms").alias(terms),
                          F.col("line_text").alias(message))


def write_csv(matches: DataFrame, path: str) -> None:
    """SNK2: CSV with header ``file,line_number,matched_terms,log_message``."""
    export_rows(in_order(matches)).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_txt(matches: DataFrame, path: str) -> None:
    """SNK3: the line text only."""
    in_order(matches).select("line_text").write.mode("overwrite").text(path)


def write_json(matches: DataFrame, path: str) -> None:
    """SNK4: NDJSON records ``file, line_number, matched_terms, log_message``."""
    (in_order(matches).select(base_name(F.col("file_path")).alias("file"), "line_number", "matched_terms",
                    F.col("line_text").alias("log_message"))
     .write.mode("overwrite").json(path))


def report_rows(numbered: DataFrame, total: Column | int, request_id: str = "",
                cache_hit: bool = False) -> DataFrame:
    """SNK5 text: ``result_no, text`` -- row 0 is the header block, then one
    numbered entry per match.  Written in ``result_no`` order with a newline
    after each row, this is the reference's report text."""
    entries = numbered.select(
        "result_no",
        F.format_string(REPORT_ENTRY,
                        F.col("result_no"), base_name(F.col("file_path")), F.col("line_number"),
                        F.col("line_text"), F.array_join("matched_terms", " ")).alias("text"))
    total_col = total if isinstance(total, Column) else F.lit(total)
    header = numbered.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("result_no"),
        F.format_string(REPORT_HEADER,
                        F.lit(request_id), total_col, F.lit("true" if cache_hit else "false")).alias("text"))
    return header.unionByName(entries)


def write_report(numbered: DataFrame, path: str, request_id: str = "") -> None:
    """SNK5: gzip text report plus the full result as JSON, in one folder."""
    total = numbered.count()
    (report_rows(numbered, total, request_id).repartitionByRange("result_no")
     .sortWithinPartitions("result_no").select("text")
     .write.mode("overwrite").option("compression", "gzip").text(f"{path}/matches_txt"))
    numbered.write.mode("overwrite").option("compression", "gzip").json(f"{path}/results_json")


def write_page(page_rows: DataFrame, fmt: str, path: str) -> None:
    """SNK6: the lines of one page as csv / json / text, column ``log_message``."""
    out = page_rows.select(F.col("line_text").alias("log_message"))
    if fmt == "csv":
        out.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        out.write.mode("overwrite").text(path)


def write_gz_logs(lines: DataFrame, path: str, order_cols: list, hour_cols: dict) -> str:
    """Write lines as gzip text logs, one file per hour folder, lines in order.
    ``hour_cols`` maps the folder levels (e.g. ``y, m, d, h``) to Columns; each
    hour's rows go to one task, so each hour becomes exactly one ``.gz`` file."""
    keys = list(hour_cols)
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.select("line", *order_cols, *[c.alias(k) for k, c in hour_cols.items()])
     .repartitionByRange(n, *keys)
     .sortWithinPartitions(*keys, *order_cols)
     .select("line", *keys)
     .write.mode("overwrite").partitionBy(*keys).option("compression", "gzip").text(path))
    return path
