import pytest
from pyspark.sql import functions as F

from logsift.operators.predicates import line_match, matched_terms
from logsift.operators.search import search, search_totals
from logsift.schemas import SearchSpec
from tests.conftest import lines_df

ROWS = [
    ("a.gz", "2026-04-07 07:59:59 | ERROR | BANK:SBI | timeout"),
    ("a.gz", "2026-04-07 08:00:00 | ERROR | BANK:HDFC | Timeout"),
    ("a.gz", "2026-04-07 18:00:59 | INFO | BANK:FINO"),
    ("a.gz", "2026-04-07 18:01:00 | ERROR | late"),
    ("a.gz", "short error"),
    ("b.gz", "no timestamp here ERROR Élan"),
    ("b.gz", "2026-04-08 12:00:00 | ERROR | élan"),
]


def _hits(spark, spec, rows=ROWS):
    df = search(lines_df(spark, rows), spec)
    return sorted((r.file_path, r.line_number, tuple(r.matched_terms)) for r in df.collect())


def test_or_and_terms(spark):
    got = _hits(spark, SearchSpec(keywords=("timeout", "ERROR", "error")))
    assert ("a.gz", 1, ("timeout", "ERROR", "error")) in got
    assert ("a.gz", 3, ()) not in got and len(got) == 6
    got = _hits(spark, SearchSpec(keywords=("error", "TIMEOUT"), mode="AND"))
    assert [(f, n) for f, n, _ in got] == [("a.gz", 1), ("a.gz", 2)]


def test_unknown_mode_is_or(spark):
    assert _hits(spark, SearchSpec(keywords=("sbi", "hdfc"), mode="and")) == \
        _hits(spark, SearchSpec(keywords=("sbi", "hdfc"), mode="OR"))


def test_exclude_applies_to_regex(spark):
    got = _hits(spark, SearchSpec(regex_pattern="ERROR", exclude_keywords=("SBI",), case_sensitive=True))
    assert ("a.gz", 1, ("regex",)) not in got
    assert ("a.gz", 2, ("regex",)) in got


def test_regex_case_modes(spark):
    ci = _hits(spark, SearchSpec(regex_pattern="élan"))  # Unicode case folding by default
    assert [(f, n) for f, n, _ in ci] == [("b.gz", 1), ("b.gz", 2)]
    cs = _hits(spark, SearchSpec(regex_pattern="élan", case_sensitive=True))
    assert [(f, n) for f, n, _ in cs] == [("b.gz", 2)]


def test_invalid_regex_fails_early(spark):
    with pytest.raises(Exception):
        search(lines_df(spark, ROWS), SearchSpec(regex_pattern="(unclosed"))


def test_time_of_day_inclusive_minutes(spark):
    got = _hits(spark, SearchSpec(keywords=("|", "short", "timestamp"), start_time="08:00", end_time="18:00"))
    nums = [(f, n) for f, n, _ in got]
    # 07:59 out, 08:00 in, 18:00:59 in (whole minute), 18:01 out, short lines pass;
    # a long line without a timestamp is compared on whatever chars 12-16 hold
    assert nums == [("a.gz", 2), ("a.gz", 3), ("a.gz", 5), ("b.gz", 2)]


def test_timestamp_range(spark):
    got = _hits(spark, SearchSpec(keywords=("error",), start_ts="2026-04-07 08:00", end_ts="2026-04-07 18:01"))
    nums = [(f, n) for f, n, _ in got]
    # end bound is 18:01:00 exactly; unparseable lines pass
    assert nums == [("a.gz", 2), ("a.gz", 4), ("a.gz", 5), ("b.gz", 1)]
    ignored = _hits(spark, SearchSpec(keywords=("error",), start_ts="nonsense"))
    assert len(ignored) == 6


def test_line_window_and_head(spark):
    got = _hits(spark, SearchSpec(keywords=("error",), from_line=2, to_line=4))
    assert [(f, n) for f, n, _ in got] == [("a.gz", 2), ("a.gz", 4), ("b.gz", 2)]
    got = _hits(spark, SearchSpec(keywords=("error",), max_lines_per_file=1))
    assert [(f, n) for f, n, _ in got] == [("a.gz", 1), ("b.gz", 1)]


def test_validation():
    with pytest.raises(ValueError):
        SearchSpec().normalized()
    with pytest.raises(ValueError):
        SearchSpec(keywords=("",)).normalized()
    with pytest.raises(ValueError):
        SearchSpec(keywords=("x",), exclude_keywords=("",)).normalized()


def test_max_matches_and_order(spark):
    spec = SearchSpec(keywords=("error",), max_matches=3)
    assert [(r.file_path, r.line_number) for r in search(lines_df(spark, ROWS), spec).collect()] == \
        [("a.gz", 1), ("a.gz", 2), ("a.gz", 4)]
    spec = SearchSpec(keywords=("error",), max_matches=3, search_order="latest")
    assert [(r.file_path, r.line_number) for r in search(lines_df(spark, ROWS), spec).collect()] == \
        [("b.gz", 1), ("b.gz", 2), ("a.gz", 1)]


def test_search_path(spark):
    rows = [("logs/x/a.gz", "error"), ("logs/xy/b.gz", "error"), ("logs/x/sub/c.gz", "error")]
    got = _hits(spark, SearchSpec(keywords=("error",), search_path="logs/x"), rows)
    assert [f for f, _, _ in got] == ["logs/x/a.gz", "logs/x/sub/c.gz"]


def test_totals(spark):
    t = search_totals(lines_df(spark, ROWS), SearchSpec(keywords=("error",))).collect()[0]
    assert (t.files_total, t.files_searched, t.lines_scanned, t.matches_found, t.percent) == (2, 2, 7, 6, 100)
    assert t.searched_size == sum(len(l.encode()) + 1 for _, l in ROWS)


def test_observed_search_metrics(spark):
    from logsift.operators.search import observed_search
    m, obs = observed_search(lines_df(spark, ROWS), SearchSpec(keywords=("error",)))
    assert m.count() == 6
    assert obs.get == {"lines_scanned": 7, "matches_found": 6}


def test_bound_parsing_and_json_roundtrip(spark):
    import datetime as dt
    from logsift.functions.text import match_from_json, match_to_json, parse_bound
    got = spark.createDataFrame([("2026-04-07 10:45",), ("2026-04-07",), ("bad",)], "t string") \
        .select(parse_bound(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [dt.datetime(2026, 4, 7, 10, 45), dt.datetime(2026, 4, 7), None]
    m = search(lines_df(spark, ROWS), SearchSpec(keywords=("timeout",)))
    back = m.select(match_from_json(match_to_json(m)).alias("r")).select("r.*").orderBy("line_number")
    assert [(r.line_number, r.matched_terms) for r in back.collect()] == [(1, ["timeout"]), (2, ["timeout"])]


def test_large_max_matches_path(spark, monkeypatch):
    from logsift.operators import search as search_mod
    monkeypatch.setattr(search_mod, "TOP_N_LIMIT", 2)
    got = search(lines_df(spark, ROWS), SearchSpec(keywords=("error",), max_matches=4, search_order="latest"))
    assert sorted((r.file_path, r.line_number) for r in got.collect()) == \
        [("a.gz", 1), ("a.gz", 2), ("b.gz", 1), ("b.gz", 2)]


def test_totals_line_window_counts_files_of_the_path(spark):
    t = search_totals(lines_df(spark, ROWS), SearchSpec(keywords=("error",), from_line=5)).collect()[0]
    # b.gz has no line 5 but is still one of the files searched
    assert (t.files_total, t.lines_scanned, t.matches_found) == (2, 1, 1)
