"""Scalar column functions (FN1-FN14).  All built-in Spark expressions, so they
stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.fixed import (  # noqa: E402,F401  (re-exported for callers)
    MINUTE_AT, MINUTE_RE, TIMESTAMP_CHARS, TIMESTAMP_LAYOUT, TOKEN_TRIM, WS_CHARS, WS_CLASS)


def trim_space(c: Column) -> Column:
    """FN3: trim Unicode whitespace at both ends (``trim`` strips spaces only;
    ``btrim`` with the character set needs no regex)."""
    return F.btrim(c, F.lit(WS_CHARS))


def _spaced(c: Column) -> Column:
    """Every whitespace character turned into a plain space (a per-character
    map), so a single-space split -- Java's fast path, no regex -- finds the
    tokens."""
    others = WS_CHARS.replace(" ", "")
    return F.translate(c, others, " " * len(others))


def fields(c: Column) -> Column:
    """FN5: split on runs of Unicode whitespace, dropping empty pieces."""
    return F.filter(F.split(_spaced(c), " "), lambda t: t != F.lit(""))


def explode_fields(df, text_col: str, keep: list[str], out: str = "token"):
    """FN5 as rows: one row per whitespace token.  ``explode`` + ``where`` stay in
    whole-stage codegen, unlike a ``filter`` lambda over the array."""
    return (df.select(*keep, F.explode(F.split(_spaced(F.col(text_col)), " ")).alias(out))
            .where(F.col(out) != F.lit("")))


def strip_token(c: Column) -> Column:
    """FN4: strip the punctuation set from both ends."""
    return F.btrim(c, F.lit(TOKEN_TRIM))


def base_name(path: Column) -> Column:
    """FN11: last path element."""
    return F.element_at(F.split(path, "/"), -1)


def parent_dir(path: Column) -> Column:
    """FN11: everything before the last ``/``."""
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def line_minute(line: Column) -> Column:
    """FN8: ``HH:MM`` at character 12, else at character 1, else null."""
    first, second = (F.substring(line, pos, 5) for pos in MINUTE_AT)
    return F.when(first.rlike(MINUTE_RE), first).when(second.rlike(MINUTE_RE), second)


def line_timestamp(line: Column) -> Column:
    """FN9 / F7: first 19 characters as ``yyyy-MM-dd HH:mm:ss``; null when they do
    not parse.  Cast straight to wall-clock time (``timestamp_ntz``), so no session time
    zone or daylight saving shifts it; the digit mask keeps the layout fixed."""
    head = F.substring(line, 1, TIMESTAMP_CHARS)
    masked = F.translate(head, "123456789", "000000000")
    return F.when(masked == F.lit("0000-00-00 00:00:00"), head.try_cast("timestamp_ntz"))


def parse_bound(text: Column) -> Column:
    """FN9: a bound as ``yyyy-MM-dd HH:mm``, else as a date; null if neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def match_to_json(df) -> Column:
    """FN13: one match row as a JSON object (the stored-record format)."""
    return F.to_json(F.struct(*[c for c in ("file_path", "line_number", "line_text", "matched_terms",
                                            "context_lines", "context_start") if c in df.columns]))


def match_from_json(c: Column) -> Column:
    """FN13: parse a stored JSON record back into the match struct."""
    from logsift.schemas import MATCH
    return F.from_json(c, MATCH)


def hour_folder(ts: Column) -> Column:
    """FN10: ``yyyy/MM/dd/HH`` folder of a timestamp."""
    return F.date_format(ts, "yyyy/MM/dd/HH")


def percent(done: Column, total: Column) -> Column:
    """FN14: integer percent, total floored at 1."""
    return F.floor(done * 100 / F.greatest(total, F.lit(1))).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    """FN14: ceiling division of non-negative integers."""
    return F.floor((a + b - 1) / b).cast("long")
