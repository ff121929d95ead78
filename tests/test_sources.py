import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from logsift.session import qualified
from logsift.sources.gzlogs import read_gz_lines
from logsift.sources.hours import hour_bounds, hour_folder_filter, hour_list
from logsift.sources.inventory import browse
from logsift.sources.stored import read_match_records
from tests.conftest import write_gz


def _lines(df):
    return [(r.line_number, r.line) for r in df.orderBy("line_number").collect()]


def test_line_splitting_edges(spark, tmpdir_path):
    # trailing \r dropped once, lone \r kept, blank lines kept, last line without newline
    write_gz(f"{tmpdir_path}/a.gz", "one\r\ntwo\rstill two\n\nfour\r\r\nlast")
    got = _lines(read_gz_lines(spark, f"{tmpdir_path}/a.gz"))
    assert got == [(1, "one"), (2, "two\rstill two"), (3, ""), (4, "four\r"), (5, "last")]


def test_single_non_gz_file_is_error(spark, tmpdir_path):
    p = f"{tmpdir_path}/x.log"
    open(p, "w").write("hi\n")
    with pytest.raises(ValueError):
        read_gz_lines(spark, p)


def test_folder_without_gz_is_empty(spark, tmpdir_path):
    open(f"{tmpdir_path}/x.log", "w").write("hi\n")
    assert read_gz_lines(spark, tmpdir_path).count() == 0


def test_recursive_and_bad_files(spark, tmpdir_path):
    write_gz(f"{tmpdir_path}/a/b/deep.gz", "x1\nx2\n")
    open(f"{tmpdir_path}/plain.gz", "w").write("not gzip at all\n")  # skipped
    open(f"{tmpdir_path}/notes.txt", "w").write("ignored\n")
    # truncated gzip keeps a readable prefix with contiguous numbers
    body = "".join(f"line {i} " + "y" * 50 + "\n" for i in range(1, 2001)).encode()
    raw = gzip.compress(body)
    with open(f"{tmpdir_path}/trunc.gz", "wb") as f:
        f.write(raw[: len(raw) // 2])
    df = read_gz_lines(spark, tmpdir_path)
    by_file = {}
    for r in df.collect():
        by_file.setdefault(r.file_path.rsplit("/", 1)[-1], []).append((r.line_number, r.line))
    assert sorted(by_file) == ["deep.gz", "trunc.gz"]
    assert sorted(by_file["deep.gz"]) == [(1, "x1"), (2, "x2")]
    t = sorted(by_file["trunc.gz"])
    assert t and [n for n, _ in t] == list(range(1, len(t) + 1))
    assert all(line.startswith(f"line {n} ") for n, line in t[:-1])


def test_numbering_many_files_one_partition(spark, tmpdir_path):
    for i in range(12):
        write_gz(f"{tmpdir_path}/f{i:02d}.gz", "".join(f"{i}-{j}\n" for j in range(1, 40 + i)))
    df = read_gz_lines(spark, tmpdir_path)
    for r in df.collect():
        i, j = r.line.split("-")
        assert int(j) == r.line_number


def test_hour_bounds_and_list():
    assert hour_bounds("2026-04-07 10:45", "2026-04-07 11:15") == ("2026/04/07/10", "2026/04/07/11")
    assert hour_list("2026-04-07", "2026-04-07")[-1] == "2026/04/07/23"
    assert len(hour_list("2026-04-07", "2026-04-07")) == 24
    with pytest.raises(ValueError):
        hour_bounds("07/04/2026", "2026-04-07")


def test_hour_folder_scan_prunes(spark, tmpdir_path):
    root = f"{tmpdir_path}/logs"
    for h in ("09", "10", "11", "12"):
        write_gz(f"{root}/2026/04/07/{h}/app.gz", f"2026-04-07 {h}:00:00 | INFO | hello\n")
    write_gz(f"{root}/2026/04/07/10/sub/nested.gz", "nested\n")  # not directly in the hour folder
    flt = hour_folder_filter("2026-04-07 10:45", "2026-04-07 11:15", qualified(spark, root))
    df = read_gz_lines(spark, root, file_filter=flt)
    files = sorted(r.file_path.split("/logs/")[1] for r in df.select("file_path").distinct().collect())
    assert files == ["2026/04/07/10/app.gz", "2026/04/07/11/app.gz"]


def test_browse(spark, tmpdir_path):
    write_gz(f"{tmpdir_path}/sub/a.gz", "a\n")
    write_gz(f"{tmpdir_path}/sub/b.gz", "b\n")
    open(f"{tmpdir_path}/sub/c.txt", "w").write("c")
    write_gz(f"{tmpdir_path}/sub/deeper/d.gz", "d\n")
    open(f"{tmpdir_path}/top.txt", "w").write("12345")
    got = {r.name: (r.is_dir, r.size, r.gz_count) for r in browse(spark, tmpdir_path).collect()}
    assert got["top.txt"] == (False, 5, 0)
    assert got["sub"] == (True, 0, 2)
    with pytest.raises(NotADirectoryError):
        browse(spark, f"{tmpdir_path}/top.txt")
    with pytest.raises(FileNotFoundError):
        browse(spark, f"{tmpdir_path}/missing")


def test_read_stored_records_skips_malformed(spark, tmpdir_path):
    p = f"{tmpdir_path}/res.ndjson"
    with open(p, "w") as f:
        f.write(json.dumps({"file_path": "a.gz", "line_number": 3, "line_text": "x",
                            "matched_terms": ["x"]}) + "\n")
        f.write("{broken json\n")
        f.write(json.dumps({"file_path": "b.gz", "line_number": 5, "line_text": "y",
                            "matched_terms": ["y"], "context_lines": ["p", "y"], "context_start": 4}) + "\n")
    rows = read_match_records(spark, p).orderBy("file_path").collect()
    assert [(r.file_path, r.line_number) for r in rows] == [("a.gz", 3), ("b.gz", 5)]
    assert rows[1].context_lines == ["p", "y"]


def test_ingest_gz_roundtrip(spark, tmpdir_path):
    from logsift.sources.gzlogs import ingest_gz
    write_gz(f"{tmpdir_path}/in/a.gz", "a1\na2\na3\n")
    write_gz(f"{tmpdir_path}/in/b.gz", "b1\n")
    out = ingest_gz(spark, f"{tmpdir_path}/in", f"{tmpdir_path}/table")
    got = sorted((r.file_path.rsplit("/", 1)[-1], r.line_number, r.line)
                 for r in spark.read.parquet(out).collect())
    assert got == [("a.gz", 1, "a1"), ("a.gz", 2, "a2"), ("a.gz", 3, "a3"), ("b.gz", 1, "b1")]


def test_hidden_files_are_skipped(spark, tmpdir_path):
    write_gz(f"{tmpdir_path}/seen.gz", "a\n")
    write_gz(f"{tmpdir_path}/_hidden.gz", "b\n")
    write_gz(f"{tmpdir_path}/.dot.gz", "c\n")
    assert [r.line for r in read_gz_lines(spark, tmpdir_path).collect()] == ["a"]
    only_hidden = f"{tmpdir_path}/h"
    write_gz(f"{only_hidden}/_x.gz", "z\n")
    assert read_gz_lines(spark, only_hidden).count() == 0
