"""One object per log source with the reference's user actions as methods:
search (stream), page, stats, downloads, browse, saved searches and the pruned
API-server search.  Every method is a Spark job over the lines DataFrame."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators import bloom, candidates, indexstore, minutes, saved, stats, tokens
from logsift.operators.search import search, search_totals
from logsift.schemas import SAVED_SEARCH, SavedSearch, SearchSpec
from logsift.session import _fs, delete_path, path_exists, path_state, qualified, work_dir
from logsift.sinks import results
from logsift.sources.gzlogs import read_gz_lines
from logsift.sources.hours import hour_folder_filter
from logsift.sources.inventory import browse


class LogEngine:
    """``lines``: a ``log_lines`` DataFrame (``file_path, line_number, line``).
    ``root``: folder for stored results and saved searches (defaults to the
    shared work folder).  ``log_root``: the prefix of ``file_path`` under which
    the ``YYYY/MM/DD/HH`` folders start (empty for an ingested events table)."""

    def __init__(self, spark: SparkSession, lines: DataFrame | None, root: str | None = None,
                 log_root: str = "", gz_path: str | None = None,
                 source: str | None = None):
        self.spark = spark
        self._lines = lines
        self.root = root or f"{work_dir(spark)}/engine"
        self.log_root = log_root
        self.gz_path = gz_path
        self.source = source or gz_path  # its files' state is part of a stored result's key

    @classmethod
    def from_gz(cls, spark: SparkSession, path: str, root: str | None = None) -> "LogEngine":
        """A gz folder, read (and numbered) on first use."""
        return cls(spark, None, root, log_root=qualified(spark, path), gz_path=path)

    @property
    def lines(self) -> DataFrame:
        if self._lines is None:
            self._lines = read_gz_lines(self.spark, self.gz_path)
        return self._lines

    @classmethod
    def from_table(cls, spark: SparkSession, path: str, root: str | None = None) -> "LogEngine":
        return cls(spark, spark.read.parquet(path), root, source=path)

    # -- search ---------------------------------------------------------------
    def search(self, spec: SearchSpec) -> DataFrame:
        """Matches (with context when asked), unordered unless ``max_matches``."""
        return search(self.lines, spec)

    def totals(self, spec: SearchSpec) -> dict:
        return search_totals(self.lines, spec).collect()[0].asDict()

    def run(self, spec: SearchSpec) -> dict:
        """The streamed search: store the matches once and return the summary
        (``query_key, total_matches, total_files, searched_size``)."""
        key = self._key(spec)
        row = results.stored_summary(self.spark, f"{self.root}/results", key).collect()[0]
        return {"query_key": key, "total_matches": row["total_matches"],
                "total_files": row["total_files"], "searched_size": row["searched_size"]}

    def _key(self, spec: SearchSpec) -> str:
        """Key of the stored result; a result that is there is found by a file listing."""
        source = self.source and f"{self.source}|{path_state(self.spark, self.source)}"
        if source:
            key = results.stored_key(None, spec, source)
            if path_exists(self.spark, f"{self.root}/results/summary/query_key={key}/_SUCCESS"):
                return key
        return results.store_results(self.lines, spec, f"{self.root}/results", source)

    def _stored(self, spec: SearchSpec) -> DataFrame:
        key = self._key(spec)
        return results.stored_matches(self.spark, f"{self.root}/results", key)

    def page(self, spec: SearchSpec, page: int = 1, page_size: int = 25) -> tuple[DataFrame, dict]:
        """One page of a stored result plus the page info."""
        info = self.run(spec)
        p, size = results.page_bounds(page, page_size)
        pages = max(-(-info["total_matches"] // size), 1)
        stored = results.stored_matches(self.spark, f"{self.root}/results", info["query_key"])
        rows = results.page_of(stored, p, size).orderBy("result_no")
        return rows, {**info, "page": p, "page_size": size, "total_pages": pages}

    def stats(self, spec: SearchSpec) -> DataFrame:
        """``dim, label, cnt, rk`` over the stored matches."""
        return stats.top_facts(self._stored(spec))

    # -- downloads --------------------------------------------------------------
    def export(self, spec: SearchSpec, fmt: str, path: str, request_id: str = "") -> None:
        """``csv`` / ``txt`` / ``json`` / ``report`` of all stored matches."""
        stored = self._stored(spec)
        if fmt == "csv":
            results.write_csv(stored, path)
        elif fmt == "txt":
            results.write_txt(stored, path)
        elif fmt == "json":
            results.write_json(stored, path)
        elif fmt == "report":
            results.write_report(stored, path, request_id)
        else:
            raise ValueError(f"unknown format {fmt}")

    def export_page(self, spec: SearchSpec, page: int, page_size: int, fmt: str, path: str) -> None:
        rows, _ = self.page(spec, page, page_size)
        results.write_page(rows, fmt, path)

    # -- browse -----------------------------------------------------------------
    def browse(self, path: str) -> DataFrame:
        return browse(self.spark, path)

    # -- saved searches ---------------------------------------------------------
    @property
    def _saved_path(self) -> str:
        return f"{self.root}/saved_searches"

    def _saved_version(self) -> int:
        """The last list that was written whole; 0 if there is none."""
        fs, hpath = _fs(self.spark, self._saved_path)
        if not fs.exists(hpath):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(hpath)]
        numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return max((n for n in numbers if path_exists(self.spark, f"{self._saved_path}/v={n}/_SUCCESS")), default=0)

    def saved_searches(self) -> DataFrame:
        version = self._saved_version()
        if not version:
            return self.spark.createDataFrame([], SAVED_SEARCH)
        return self.spark.read.schema(SAVED_SEARCH).parquet(f"{self._saved_path}/v={version}")

    def _write_saved(self, df: DataFrame) -> None:
        # each list is a folder of its own, current once it is whole; a driver lost on the way
        # leaves the last list as it is
        version = self._saved_version()
        df.coalesce(1).write.mode("overwrite").parquet(f"{self._saved_path}/v={version + 1}")
        if version > 1:  # the list before stays for readers that began with it
            delete_path(self.spark, f"{self._saved_path}/v={version - 1}")

    def add_saved(self, name: str, keywords, mode: str = "OR", path: str = "") -> SavedSearch:
        s = SavedSearch(id=str(datetime.now().timestamp()).replace(".", ""), name=name,
                        keywords=tuple(keywords), mode=mode, path=path,
                        created_at=datetime.now().strftime("%Y-%m-%d %H:%M:%S"))
        self._write_saved(self.saved_searches().unionByName(saved.saved_table(self.spark, [s])))
        return s

    def delete_saved(self, search_id: str) -> None:
        self._write_saved(saved.delete_saved(self.saved_searches(), search_id))

    def apply_saved(self) -> DataFrame:
        return saved.apply_saved(self.lines, self.saved_searches())

    # -- search from a time of day --------------------------------------------
    def search_from(self, spec: SearchSpec, start_time: str) -> DataFrame:
        """Matches from each file's start line for ``start_time`` on (minute index, stored
        once per state of the logs).  Line windows and context count as in ``search``."""
        path = self._index_path("minutes")
        if path is None:
            index = minutes.minute_index(self.lines)
        else:
            if not path_exists(self.spark, f"{path}/_SUCCESS"):
                minutes.minute_index(self.lines).write.mode("overwrite").parquet(path)
            index = self.spark.read.parquet(path)
        return search(minutes.lines_from(self.lines, index, start_time), spec)

    # -- API-server search ------------------------------------------------------
    def pruned_search(self, start: str, end: str, keywords, mode: str = "OR",
                      index: DataFrame | None = None, blooms: DataFrame | None = None) -> DataFrame:
        """Hour folders → bloom → token index, then a keyword search of the candidate files
        only.  Without ``index`` and ``blooms`` those of ``build_indexes`` are used while the
        logs are unchanged; with any of them no gzip file but the candidates is opened."""
        mode = mode if mode in ("AND", "OR") else "OR"
        if index is None and blooms is None:
            index, blooms = self.indexes()
        spec = SearchSpec(keywords=tuple(keywords), mode=mode)
        gz = self.gz_path is not None and self._lines is None
        in_range = hour_folder_filter(start, end, self.log_root)
        if gz and (index is not None or blooms is not None):
            cands, paths = candidates.listed(candidates.candidate_files(
                None, start, end, keywords, mode, root=self.log_root, blooms=blooms, index=index))
            opened = in_range if paths is None else in_range & candidates.among(paths)
            lines = read_gz_lines(self.spark, self.gz_path, file_filter=opened)
            return search(lines if paths is not None else candidates.scan_candidates(lines, cands, self.log_root), spec)
        # gz without any index: only the hour folders in range are opened (filter before numbering)
        lines = read_gz_lines(self.spark, self.gz_path, file_filter=in_range) if gz else self.lines
        cands = candidates.candidate_files(lines, start, end, keywords, mode,
                                           root=self.log_root, blooms=blooms, index=index)
        return search(candidates.scan_candidates(lines, cands, self.log_root), spec)

    def _index_path(self, kind: str) -> str | None:
        if not self.source:
            return None
        state = hashlib.sha256(f"{self.source}|{path_state(self.spark, self.source)}".encode()).hexdigest()[:16]
        return f"{self.root}/indexes/{kind}-{state}"

    def build_indexes(self) -> None:
        """Token index and bloom bitmaps of all lines, stored for the logs as they are now."""
        if not self.source:
            raise ValueError("an engine over a plain DataFrame has no source to index")
        tokens.write_index(tokens.file_keywords(self.lines), self._index_path("tokens"))
        bloom.write_blooms(bloom.build_blooms(self.lines), self._index_path("bloom-words"))

    def indexes(self) -> tuple[DataFrame | None, DataFrame | None]:
        """(token index, blooms) as stored for the logs' present state; None where there is none."""
        paths = [self._index_path(kind) for kind in ("tokens", "bloom-words")]
        return tuple(self.spark.read.parquet(p) if p and path_exists(self.spark, f"{p}/_SUCCESS") else None for p in paths)

    def build_index(self, path: str) -> str:
        return tokens.write_index(tokens.file_keywords(self.lines), path)

    def refresh_index(self) -> DataFrame:
        """``file_path, keyword`` of the gz folder as it is now: files that are new, changed or
        gone since the last call are the only ones read and rewritten.  It serves
        ``pruned_search(..., index=...)`` while the logs grow."""
        if not self.gz_path:
            raise ValueError("only a gz folder is indexed file by file")
        folder = hashlib.sha256(self.log_root.encode()).hexdigest()[:16]
        root = f"{self.root}/indexes/tokens-by-file-{folder}"
        indexstore.refresh_index(self.spark, self.gz_path, root)
        return indexstore.read_index(self.spark, root)
