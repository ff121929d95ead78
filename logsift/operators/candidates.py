"""Candidate-file pruning (A12): hour folders, then bloom filters, then the
token index (J3 intersects the last two), and scanning only the candidates
(J2).  Each stage is optional.  As in the reference this is *token* search: a
file passes for ``timeout`` only if some whole token equals it.

Candidates decide what is opened.  They are staged and counted; up to LISTED_FILES they
become a predicate on ``file_path`` (and on the day partitions they lie in) that the scan
itself applies: partitions, row groups and gzip files without a candidate are not read.
Beyond that, days still prune and the rest is a semi join, broadcast below a bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.operators.bloom import build_blooms, probe
from logsift.operators.keyfilter import BROADCAST_BYTES, measured_bytes
from logsift.operators.tokens import files_for_keywords
from logsift.session import materialize
from logsift.sources.hours import day_of, hour_folder_filter

LISTED_FILES = 10_000  # candidate files whose paths are sent to the scan as a list
LISTED_DAYS = 10_000  # and days


def candidate_files(lines: DataFrame | None, start: str, end: str, keywords, mode: str = "OR",
                    root: str = "", blooms: DataFrame | None = None,
                    index: DataFrame | None = None) -> DataFrame:
    """``file_path`` of the files that may hold the keywords.

    ``blooms``/``index`` are prebuilt tables; without ``blooms`` the filters are
    built from the in-range lines (what the reference does on each query), or left out if
    ``lines`` is None and there is an ``index``."""
    mode = mode if mode in ("AND", "OR") else "OR"
    hits = None if index is None else files_for_keywords(
        index.where(hour_folder_filter(start, end, root)), keywords, mode)
    if blooms is not None:
        blooms = blooms.where(hour_folder_filter(start, end, root))
    elif lines is not None:
        blooms = build_blooms(lines.where(hour_folder_filter(
            start, end, root, dt=F.col("dt") if "dt" in lines.columns else None)))
    elif hits is None:
        raise ValueError("lines, blooms or an index are needed")
    if blooms is None:
        return hits
    cands = probe(blooms, keywords, mode)
    return cands if hits is None else cands.join(hits, "file_path", "left_semi")


def listed(candidates: DataFrame, most: int = LISTED_FILES) -> tuple[DataFrame, list[str] | None]:
    """The distinct candidates staged, and their paths if there are ``most`` or fewer."""
    staged = materialize(candidates.select("file_path").distinct(), "candidates")
    if staged.count() > most:  # from the files' footers
        return staged, None
    return staged, [r["file_path"] for r in staged.collect()]


def among(paths: list[str]) -> Column:
    return F.col("file_path").isin(paths) if paths else F.lit(False)


def scan_candidates(lines: DataFrame, candidates: DataFrame, root: str = "", most: int = LISTED_FILES) -> DataFrame:
    """J2 for tables: the lines of candidate files; what holds none of them is not read."""
    staged, paths = listed(candidates, most)
    if "dt" in lines.columns:
        found = [r["dt"] for r in staged.select(day_of("file_path", root).alias("dt")).distinct()
                 .limit(LISTED_DAYS + 1).collect()]
        if len(found) <= LISTED_DAYS:
            lines = lines.where(F.col("dt").isin(found) if found else F.lit(False))
    if paths is not None:
        return lines.where(among(paths))
    small = F.broadcast(staged) if measured_bytes(staged) <= BROADCAST_BYTES else staged
    return lines.join(small, "file_path", "left_semi")
