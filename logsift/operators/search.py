"""Search (P1, SL1, SL2, SL4, U1) and search totals.

``lines`` is any DataFrame with ``file_path, line_number, line`` -- an ingested
Parquet table, gz logs read by ``sources.gzlogs`` or one of the table views.
Filters on ``file_path`` and ``line_number`` come first so they reach the scan
(partition pruning, Parquet row-group skipping)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logsift.functions.text import percent
from logsift.operators.predicates import (
    check_regex, line_match, line_window, matched_terms, path_filter)
from logsift.schemas import SearchSpec

# Up to this many, the first N matches come from a top-N sort (each task keeps
# N rows, one task merges).  Above it, matches are numbered with the
# range-partitioned global numbering and filtered, so no task holds N rows.
TOP_N_LIMIT = 100_000


def lines_read(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """Lines a search reads: in the search path, within the line window."""
    out = lines
    for cond in (path_filter(spec.search_path), line_window(spec)):
        if cond is not None:
            out = out.where(cond)
    return out


def search(lines: DataFrame, spec: SearchSpec, check: bool = True) -> DataFrame:
    """Matches: ``file_path, line_number, line_text, matched_terms`` (plus
    ``context_lines, context_start`` when ``context_lines`` > 0).

    Unordered unless ``max_matches`` is set; then the first N in search order
    (files ascending, or descending for ``latest``; lines ascending)."""
    spec = spec.normalized()
    if check:
        check_regex(lines.sparkSession, spec)
    m = (lines_read(lines, spec)
         .where(line_match(spec, F.col("line")))
         .select("file_path", "line_number",
                 F.col("line").alias("line_text"),
                 matched_terms(spec, F.col("line")).alias("matched_terms")))
    if 0 < spec.max_matches <= TOP_N_LIMIT:
        m = ordered(m, spec).limit(spec.max_matches)
    elif spec.max_matches > TOP_N_LIMIT:
        from logsift.operators.numbering import number_rows
        fp = F.col("file_path").desc() if spec.search_order == "latest" else F.col("file_path").asc()
        m = (number_rows(m, [fp, F.col("line_number").asc()], [], out_col="_rank")
             .where(F.col("_rank") <= spec.max_matches).drop("_rank"))
    if spec.context_lines > 0:
        from logsift.operators.context import context_join, nearby_lines
        # context comes from every line read (the line window limits matches only)
        source = lines
        for cond in (path_filter(spec.search_path),
                     line_window(SearchSpec(keywords=("x",), max_lines_per_file=spec.max_lines_per_file))):
            if cond is not None:
                source = source.where(cond)
        m = context_join(m, nearby_lines(source, m, spec.context_lines), spec.context_lines)
    return m


def ordered(matches: DataFrame, spec: SearchSpec) -> DataFrame:
    """SL1: files ascending (or descending for ``latest``), lines ascending."""
    fp = F.col("file_path").desc() if spec.search_order == "latest" else F.col("file_path").asc()
    return matches.orderBy(fp, F.col("line_number").asc())


def search_totals(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """One row -- files total/searched and bytes over every file in the
    search path; lines scanned and matches within the line window; percent.
    Bytes are the UTF-8 bytes of the lines plus their newlines."""
    spec = spec.normalized()
    base = lines
    p = path_filter(spec.search_path)
    if p is not None:
        base = base.where(p)
    win = line_window(spec)
    win = F.lit(True) if win is None else win
    agg = base.agg(
        F.count_distinct("file_path").alias("files_total"),
        F.count_if(win).alias("lines_scanned"),
        F.count_if(win & line_match(spec, F.col("line"))).alias("matches_found"),
        F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).cast("long").alias("searched_size"),
    )
    return agg.select(
        "files_total",
        F.col("files_total").alias("files_searched"),
        "lines_scanned", "matches_found",
        percent(F.col("files_total"), F.col("files_total")).alias("percent"),
        "searched_size")


def observed_search(lines: DataFrame, spec: SearchSpec) -> tuple[DataFrame, Observation]:
    """A7 as a side metric: the matches, plus an Observation that holds
    ``lines_scanned`` and ``matches_found`` once the matches have been computed
    (same scan, no second pass)."""
    spec = spec.normalized()
    check_regex(lines.sparkSession, spec)
    obs = Observation("search_progress")
    pred = line_match(spec, F.col("line"))
    read = lines_read(lines, spec).observe(
        obs, F.count(F.lit(1)).alias("lines_scanned"), F.count_if(pred).alias("matches_found"))
    m = read.where(pred).select("file_path", "line_number", F.col("line").alias("line_text"),
                                matched_terms(spec, F.col("line")).alias("matched_terms"))
    return m, obs
