"""Faults found by probes: each test failed before its mend."""

import os

import pytest

from logsift.engine import LogEngine
from logsift.operators import minutes, saved, tokens
from logsift.operators.search import search
from logsift.schemas import SavedSearch, SearchSpec
from logsift.session import path_state
from logsift.sinks import results
from logsift.sources.gzlogs import read_gz_lines
from logsift.sources.inventory import browse
from tests.conftest import APP_10, lines_df, write_gz

ERROR = SearchSpec(keywords=("error",))


def texts(df):
    return sorted(r.line_text for r in df.collect())


def test_sources_of_one_size_do_not_share_results(spark, tmpdir_path):
    a = lines_df(spark, [("x", "ERROR one"), ("x", "ok 123456")])
    b = lines_df(spark, [("x", "ok 123456"), ("x", "ERROR two")])
    keys = [results.store_results(d, ERROR, tmpdir_path) for d in (a, b)]
    assert keys[0] != keys[1]
    assert [texts(results.stored_matches(spark, tmpdir_path, k)) for k in keys] == [["ERROR one"], ["ERROR two"]]


def test_stored_context_columns_survive_other_results(spark, tmpdir_path):
    lines = lines_df(spark, [("x", "ERROR one"), ("x", "next")])
    plain = results.store_results(lines, ERROR, tmpdir_path)
    wide = results.store_results(lines, SearchSpec(keywords=("error",), context_lines=1), tmpdir_path)
    assert results.stored_matches(spark, tmpdir_path, wide).first().context_lines == ["ERROR one", "next"]
    assert "context_lines" not in results.stored_matches(spark, tmpdir_path, plain).columns


def test_repeated_run_reads_no_log(spark, tmpdir_path, monkeypatch):
    write_gz(f"{tmpdir_path}/logs/a.log.gz", APP_10)
    first = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", f"{tmpdir_path}/work")
    info = first.run(ERROR)
    again = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", f"{tmpdir_path}/work")
    rows, page = again.page(ERROR)
    assert page["query_key"] == info["query_key"] and rows.count() == info["total_matches"] == 2
    assert again._lines is None  # the logs were never opened
    write_gz(f"{tmpdir_path}/logs/b.log.gz", APP_10)
    assert LogEngine.from_gz(spark, f"{tmpdir_path}/logs", f"{tmpdir_path}/work").run(ERROR)["total_matches"] == 4


def test_paths_with_blanks_and_schemes(spark, tmpdir_path):
    root = f"{tmpdir_path}/my +logs"
    write_gz(f"{root}/a/2026/04/07/10/app.log.gz", APP_10)
    write_gz(f"{root}/b/app.log.gz", APP_10)
    os.makedirs(f"{root}/empty")
    for path in (root, f"file:{root}", f"file://{root}"):
        lines = read_gz_lines(spark, path)
        assert {r.file_path for r in lines.select("file_path").distinct().collect()} == {
            f"file:{root}/a/2026/04/07/10/app.log.gz", f"file:{root}/b/app.log.gz"}
        for inner, n in ((f"{root}/a", 2), (f"file:{root}/a", 2), (f"file://{root}/b", 2), (root, 4)):
            assert search(lines, SearchSpec(keywords=("error",), search_path=inner)).count() == n
        got = {r.name: (r.is_dir, r.gz_count) for r in browse(spark, path).collect()}
        assert got == {"a": (True, 0), "b": (True, 1), "empty": (True, 0)}
    engine = LogEngine.from_gz(spark, f"{root}/a", f"{tmpdir_path}/work")
    assert engine.pruned_search("2026-04-07 10:00", "2026-04-07 10:59", ["error"]).count() == 2
    with pytest.raises(ValueError):
        open(f"{root}/x.txt", "w").close()
        read_gz_lines(spark, f"file:{root}/x.txt")
    assert path_state(spark, root) != path_state(spark, f"{root}/a")


def test_csv_keeps_blanks_and_doubles_quotes(spark, tmpdir_path):
    matches = search(lines_df(spark, [("d/f", '  ERROR "q" back\\slash,  ')]), ERROR)
    results.write_csv(matches, f"{tmpdir_path}/csv")
    parts = [open(f"{tmpdir_path}/csv/{f}").read().splitlines() for f in sorted(os.listdir(f"{tmpdir_path}/csv"))
             if f.endswith(".csv")]
    assert all(p[0] == "file,line_number,matched_terms,log_message" for p in parts if p)  # a part may be empty
    assert [line for p in parts for line in p[1:]] == ['f,1,error,"  ERROR ""q"" back\\slash,  "']


def test_exports_follow_search_order(spark, tmpdir_path):
    lines = lines_df(spark, [(f"f{i % 7}", f"ERROR {i:05d}") for i in range(3000)])
    key = results.store_results(lines.repartition(9), ERROR, tmpdir_path)
    results.write_txt(results.stored_matches(spark, tmpdir_path, key), f"{tmpdir_path}/txt")
    parts = sorted(f for f in os.listdir(f"{tmpdir_path}/txt") if f.startswith("part"))
    got = [line for p in parts for line in open(f"{tmpdir_path}/txt/{p}").read().splitlines()]
    want = [r.line_text for r in search(lines, ERROR).orderBy("file_path", "line_number").collect()]
    assert got == want


@pytest.mark.parametrize("pattern,line", [("a.b", "a\rb"), ("a.b", "a b"), ("a.b", "a\u0085b")])
def test_only_newlines_end_a_line_in_a_regex(spark, pattern, line):
    df = spark.createDataFrame([("f", 1, line), ("f", 2, "four\r")], "file_path string, line_number long, line string")
    assert search(df, SearchSpec(regex_pattern=pattern)).count() == 1
    assert search(df, SearchSpec(regex_pattern="four$")).count() == 0


def test_time_range_ignores_the_session_zone(spark):
    df = lines_df(spark, [("f", "2026-03-08 02:30:00 | ERROR"), ("f", "2026-03-08 03:30:00 | ERROR")])
    spec = SearchSpec(keywords=("error",), start_ts="2026-03-08 02:00", end_ts="2026-03-08 02:59")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r.line_number for r in search(df, spec).collect()] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_replaced_file_without_tokens_loses_its_rows(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "file_path string, keyword string")
    files = spark.createDataFrame([("a",)], "file_path string")
    assert [tuple(r) for r in tokens.replace_files(old, old.limit(0), files).collect()] == [("b", "y")]


def test_saved_search_with_an_empty_keyword_is_refused(spark):
    table = saved.saved_table(spark, [SavedSearch("1", "n", ("", "x"), "OR", "", "")])
    with pytest.raises(ValueError):
        saved.apply_saved(lines_df(spark, [("f", "x")]), table)


def test_seek_past_the_margin(spark):
    lines = lines_df(spark, [("f", f"2026-04-07 {i // 180:02d}:{i // 3 % 60:02d}:00 | x") for i in range(2400)])
    index = minutes.minute_index(lines)
    assert minutes.seek_line(index, "09:59").first().start_line == 1798 - 1000
    assert minutes.seek_line(index, "09:59", margin=0).first().start_line == 1798


def test_context_has_the_match_and_its_terms(spark):
    lines = lines_df(spark, [("f", "a"), ("f", "ERROR b"), ("f", "ERROR c"), ("f", "d")])
    got = search(lines, SearchSpec(keywords=("error",), context_lines=1)).orderBy("line_number").collect()
    assert [(r.line_text, r.matched_terms, r.context_lines, r.context_start) for r in got] == [
        ("ERROR b", ["error"], ["a", "ERROR b", "ERROR c"], 1), ("ERROR c", ["error"], ["ERROR b", "ERROR c", "d"], 2)]


def test_lookups_read_the_stored_index(spark):
    from logsift.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    for name in ("files_or", "files_and", "files_union", "files_intersect", "bloom_probe", "prune_candidates"):
        QUERIES[name](spark, sf)  # builds the index where it is missing
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "Generate explode(split" not in plan and "/indexes/" in plan, name


def test_numbered_stream_whatever_the_split(spark, tmpdir_path):
    from logsift.plans import params as P
    from logsift.sources.tables import event_lines
    from logsift.streaming import live
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id % 3 = 0").write.parquet(f"{tmpdir_path}/events.parquet/a=1")
    events.where("event_id % 3 <> 0").write.parquet(f"{tmpdir_path}/events.parquet/a=2")
    for part in ("a=1", "a=2"):
        folder = f"{tmpdir_path}/events.parquet/{part}"
        for f in os.listdir(folder):
            if f.startswith("part"):
                os.link(f"{folder}/{f}", f"{tmpdir_path}/events-{part[2:]}.parquet")
    schema_dir = f"{tmpdir_path}/sf"
    os.makedirs(f"{schema_dir}/events.parquet")
    for i in (1, 2):
        os.link(f"{tmpdir_path}/events-{i}.parquet", f"{schema_dir}/events.parquet/part-{i}.parquet")
    got = live.stream_search_events_numbered(spark, schema_dir, P.SEARCH_AND)
    want = search(event_lines(spark, schema_dir), P.SEARCH_AND).select("file_path", "line_number", "line_text")
    assert sorted(map(tuple, got.select("file_path", "line_number", "line_text").collect())) \
        == sorted(map(tuple, want.collect())) and got.count() > 0
    totals = live.stream_totals_events(spark, schema_dir, P.SEARCH_OR).first()
    assert totals.lines_scanned == events.count()
