"""Fixed schemas and the search specification."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

LOG_LINES = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("line_number", T.LongType(), False),
    T.StructField("line", T.StringType(), True),
])

MATCH = T.StructType([
    T.StructField("file_path", T.StringType(), True),
    T.StructField("line_number", T.LongType(), True),
    T.StructField("line_text", T.StringType(), True),
    T.StructField("matched_terms", T.ArrayType(T.StringType()), True),
    T.StructField("context_lines", T.ArrayType(T.StringType()), True),
    T.StructField("context_start", T.LongType(), True),
])

SAVED_SEARCH = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), True),
    T.StructField("keywords", T.ArrayType(T.StringType()), True),
    T.StructField("mode", T.StringType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("created_at", T.StringType(), True),
])

from logsift.fixed import MAX_CONTEXT  # noqa: E402,F401


@dataclass(frozen=True)
class SearchSpec:
    """One search, with the fields of the reference's query object.

    ``start_time``/``end_time`` are time-of-day bounds (``HH:MM``);
    ``start_ts``/``end_ts`` are full timestamp bounds (``yyyy-MM-dd HH:mm``).
    """
    keywords: tuple = ()
    exclude_keywords: tuple = ()
    regex_pattern: str = ""
    case_sensitive: bool = False
    start_time: str = ""
    end_time: str = ""
    mode: str = "OR"
    request_id: str = ""
    from_line: int = 0
    to_line: int = 0
    search_path: str = ""
    context_lines: int = 0
    search_order: str = ""
    max_lines_per_file: int = 0
    max_matches: int = 0
    start_ts: str = ""
    end_ts: str = ""

    def normalized(self) -> "SearchSpec":
        """Validate and fill defaults: unknown modes become OR; a search needs
        keywords or a regex; empty keywords are refused."""
        kws = tuple(self.keywords or ())
        exc = tuple(self.exclude_keywords or ())
        if not kws and not self.regex_pattern:
            raise ValueError("keywords or regex required")
        if any(k == "" for k in kws):
            raise ValueError("empty keyword")
        if any(k == "" for k in exc):
            raise ValueError("empty exclude keyword")
        mode = self.mode if self.mode in ("AND", "OR") else "OR"
        return replace(self, keywords=kws, exclude_keywords=exc, mode=mode)

    def canonical_json(self) -> str:
        """Stable JSON of every field but the request id (input of the query key)."""
        d = asdict(self)
        d.pop("request_id")
        d["keywords"] = list(d["keywords"])
        d["exclude_keywords"] = list(d["exclude_keywords"])
        return json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@dataclass(frozen=True)
class SavedSearch:
    id: str
    name: str
    keywords: tuple = field(default_factory=tuple)
    mode: str = "OR"
    path: str = ""
    created_at: str = ""
