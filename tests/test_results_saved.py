import gzip
import os

from pyspark.sql import functions as F

from logsift.operators.saved import apply_saved, delete_saved, saved_table
from logsift.operators import saved as saved_mod
from logsift.operators.search import search
from logsift.schemas import SavedSearch, SearchSpec
from logsift.sinks import results
from tests.conftest import lines_df

ROWS = [(f"d/f{i % 4}.gz", f"2026-04-07 10:{i % 60:02d}:00 | {'ERROR' if i % 3 == 0 else 'INFO'} | n{i}")
        for i in range(230)]


def test_store_pages_concat_to_full(spark, tmpdir_path):
    lines = lines_df(spark, ROWS)
    spec = SearchSpec(keywords=("error",))
    root = f"{tmpdir_path}/results"
    key = results.store_results(lines, spec, root)
    assert key == results.store_results(lines, spec, root)  # reused
    stored = results.stored_matches(spark, root, key)
    full = [(r.file_path, r.line_number) for r in search(lines, spec).orderBy("file_path", "line_number").collect()]
    pages, p = [], 1
    while True:
        rows = results.page_of(stored, p, 25).orderBy("result_no").collect()
        if not rows:
            break
        pages += [(r.file_path, r.line_number) for r in rows]
        p += 1
    assert pages == full
    summary = results.stored_summary(spark, root, key).collect()[0]
    assert summary.total_matches == len(full) and summary.total_files == 4
    assert results.page_bounds(0, 0) == (1, 25) and results.page_bounds(2, 9999) == (2, 500)
    tp = spark.range(1).select(results.total_pages(F.lit(len(full)), 25).alias("t")).collect()[0].t
    assert tp == -(-len(full) // 25)


def test_query_key_changes_with_files(spark):
    spec = SearchSpec(keywords=("error",), request_id="a")
    k1 = results.result_summary(lines_df(spark, ROWS), spec).collect()[0].query_key
    k2 = results.result_summary(lines_df(spark, ROWS), SearchSpec(keywords=("error",), request_id="b")) \
        .collect()[0].query_key
    k3 = results.result_summary(lines_df(spark, ROWS[:-1]), spec).collect()[0].query_key
    assert k1 == k2 and k1 != k3


def test_exports_and_report(spark, tmpdir_path):
    lines = lines_df(spark, ROWS)
    m = search(lines, SearchSpec(keywords=("error", "n3"), max_matches=3))
    rows = results.export_rows(m).collect()
    assert rows[0].file == "f0.gz" and rows[0].matched_terms in ("error", "error|n3")
    results.write_csv(m, f"{tmpdir_path}/csv")
    text = "".join(open(os.path.join(f"{tmpdir_path}/csv", f)).read()
                   for f in sorted(os.listdir(f"{tmpdir_path}/csv")) if f.endswith(".csv"))
    assert text.startswith("file,line_number,matched_terms,log_message\n")
    numbered = results.numbered_matches(m, SearchSpec(keywords=("error",)))
    results.write_report(numbered, f"{tmpdir_path}/rep", request_id="rid")
    parts = sorted(f for f in os.listdir(f"{tmpdir_path}/rep/matches_txt") if f.endswith(".gz"))
    body = "".join(gzip.open(os.path.join(f"{tmpdir_path}/rep/matches_txt", f), "rt").read() for f in parts)
    assert body.startswith("Log Search Results\n==================\nRequest ID   : rid\nTotal Matches: 3\n"
                           "Cache Hit    : false\n==================\n\n[1] File: f0.gz\n    Line 1: ")
    assert "    Terms: [error]\n\n[2] File:" in body
    results.write_page(results.page_of(numbered, 1, 2), "json", f"{tmpdir_path}/page")
    assert spark.read.json(f"{tmpdir_path}/page").columns == ["log_message"]


def test_saved_searches_match_brute_force(spark, monkeypatch):
    lines = lines_df(spark, ROWS)
    searches = [SavedSearch("s1", "e", ("error",), "OR", "", ""),
                SavedSearch("s2", "e0", ("error", "n1"), "AND", "d/f0.gz", ""),
                SavedSearch("s3", "x", ("n2", "N5"), "weird", "d", "")]
    monkeypatch.setattr(saved_mod, "CHUNK", 2)  # exercise the chunked path
    got = sorted((r.search_id, r.file_path, r.line_number)
                 for r in apply_saved(lines, saved_table(spark, searches)).collect())
    expect, counters = [], {}
    for fp, line in ROWS:
        counters[fp] = counters.get(fp, 0) + 1
        lo = line.lower()
        if "error" in lo:
            expect.append(("s1", fp, counters[fp]))
        if fp == "d/f0.gz" and "error" in lo and "n1" in lo:
            expect.append(("s2", fp, counters[fp]))
        if "n2" in lo or "n5" in lo:
            expect.append(("s3", fp, counters[fp]))
    assert got == sorted(expect)
    left = delete_saved(saved_table(spark, searches), "s1")
    assert {r.id for r in left.collect()} == {"s2", "s3"}
