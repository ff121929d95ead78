"""Line predicates (F1-F9) and matched terms (P2), built as one Column from a
SearchSpec.  Order inside the conjunction follows the reference: time, exclude,
then regex or keywords; Spark's codegen keeps that short-circuit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.fixed import REGEX_TERM, TIME_OF_DAY_LEN, TIME_OF_DAY_MIN_LINE, TIME_OF_DAY_START
from logsift.functions.text import line_timestamp
from logsift.schemas import SearchSpec


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def keyword_hits(keywords, lower_line: Column) -> list[Column]:
    """One ``contains`` per keyword on the lower-cased line (F1/F2).  Keywords are
    lower-cased by Spark too, so both sides use the same case rules."""
    return [F.contains(lower_line, F.lower(F.lit(k))) for k in keywords]


def time_of_day(line: Column, start: str, end: str) -> Column | None:
    """chars 12-16 compared as text with both ends inclusive; lines shorter
    than 19 chars pass.  Bounds are trimmed and cut to 5 chars."""
    s, e = (start or "").strip()[:TIME_OF_DAY_LEN], (end or "").strip()[:TIME_OF_DAY_LEN]
    if not (start or end):
        return None
    hhmm = F.substring(line, TIME_OF_DAY_START, TIME_OF_DAY_LEN)
    conds = []
    if s:
        conds.append(hhmm >= F.lit(s))
    if e:
        conds.append(hhmm <= F.lit(e))
    if not conds:
        return None
    return (F.length(line) < TIME_OF_DAY_MIN_LINE) | _all(conds)


def _parse_bound(text: str):
    from datetime import datetime
    try:
        return datetime.strptime(text.strip(), "%Y-%m-%d %H:%M")
    except ValueError:
        return None


def time_range(line: Column, start_ts: str, end_ts: str) -> Column | None:
    """the line's leading timestamp within [start, end] (end at second :00);
    lines without a parseable timestamp pass; a bound that is not ``YYYY-MM-DD HH:MM`` is
    ignored, as the reference does (decided against refusing it)."""
    s = _parse_bound(start_ts) if start_ts else None
    e = _parse_bound(end_ts) if end_ts else None
    if s is None and e is None:
        return None
    ts = line_timestamp(line)
    conds = []
    # wall-clock literals, like the line's own timestamp
    if s is not None:
        conds.append(ts >= F.lit(s.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
    if e is not None:
        conds.append(ts <= F.lit(e.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
    return ts.isNull() | _all(conds)


def regex_column(spec: SearchSpec) -> str:
    """the pattern Spark runs.  Case-insensitive by default; ``(?iu)``
    because Java's ``(?i)`` alone folds ASCII only; ``(?d)`` so that only ``\\n``
    ends a line for ``.`` and ``$``."""
    return ("(?d)" if spec.case_sensitive else "(?iud)") + spec.regex_pattern


def check_regex(spark, spec: SearchSpec) -> None:
    """Fail early on an invalid pattern (the reference refuses the search)."""
    if spec.regex_pattern:
        spark.range(1).select(F.lit("").rlike(regex_column(spec))).collect()


def line_match(spec: SearchSpec, line: Column | None = None) -> Column:
    """the whole per-line predicate of a search."""
    line = F.col("line") if line is None else line
    spec = spec.normalized()
    lower = F.lower(line)
    parts = []
    tod = time_of_day(line, spec.start_time, spec.end_time)
    if tod is not None:
        parts.append(tod)
    tr = time_range(line, spec.start_ts, spec.end_ts)
    if tr is not None:
        parts.append(tr)
    if spec.exclude_keywords:
        parts.append(~_any(keyword_hits(spec.exclude_keywords, lower)))
    if spec.regex_pattern:
        parts.append(line.rlike(regex_column(spec)))
    else:
        hits = keyword_hits(spec.keywords, lower)
        parts.append(_all(hits) if spec.mode == "AND" else _any(hits))
    return _all(parts)


def matched_terms(spec: SearchSpec, line: Column | None = None) -> Column:
    """Keywords found, in query order and original case, duplicates kept;
    ``["regex"]`` for a regex search."""
    line = F.col("line") if line is None else line
    spec = spec.normalized()
    if spec.regex_pattern:
        return F.array(F.lit(REGEX_TERM))
    lower = F.lower(line)
    # concat of one-element arrays: plain expressions, unlike array_compact/filter
    # (lambda functions run outside whole-stage codegen)
    empty = F.array().cast("array<string>")
    return F.concat(*[
        F.when(hit, F.array(F.lit(k))).otherwise(empty)
        for k, hit in zip(spec.keywords, keyword_hits(spec.keywords, lower))
    ])


def path_filter(search_path: str, file_path: Column | None = None) -> Column | None:
    """Restrict to one file or a folder (by path prefix)."""
    file_path = F.col("file_path") if file_path is None else file_path
    if not search_path:
        return None
    p = search_path.rstrip("/")
    if p.startswith("/"):  # a plain path: compare with the path part, whatever the file system
        file_path = F.regexp_replace(file_path, r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    elif p.startswith("file:"):
        p = "file:/" + p[len("file:"):].lstrip("/")
    return (file_path == F.lit(p)) | file_path.startswith(p + "/")


def line_window(spec: SearchSpec, line_number: Column | None = None) -> Column | None:
    """F8 (line range, 0 = open) and SL4 (first N lines per file)."""
    line_number = F.col("line_number") if line_number is None else line_number
    conds = []
    if spec.from_line > 0:
        conds.append(line_number >= F.lit(spec.from_line))
    if spec.to_line > 0:
        conds.append(line_number <= F.lit(spec.to_line))
    if spec.max_lines_per_file > 0:
        conds.append(line_number <= F.lit(spec.max_lines_per_file))
    return _all(conds) if conds else None
