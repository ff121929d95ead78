"""The reference's own five search tests, re-created on gz files."""

from logsift.operators.search import search
from logsift.schemas import SearchSpec
from logsift.sources.gzlogs import read_gz_lines


def _file(spark, d, name):
    return read_gz_lines(spark, f"{d}/{name}")


def test_or(spark, ref_logs):
    m = search(_file(spark, ref_logs, "app-2026-04-07-10.log.gz"), SearchSpec(keywords=("ERROR",)))
    nums = [r.line_number for r in m.orderBy("line_number").collect()]
    assert nums == [2, 4]


def test_and(spark, ref_logs):
    m = search(_file(spark, ref_logs, "app-2026-04-07-10.log.gz"),
               SearchSpec(keywords=("ERROR", "timeout"), mode="AND")).collect()
    assert [r.line_number for r in m] == [4]


def test_no_match(spark, ref_logs):
    m = search(_file(spark, ref_logs, "clean-2026-04-07-10.log.gz"), SearchSpec(keywords=("CRITICAL",)))
    assert m.count() == 0


def test_parallel_three_files(spark, ref_logs):
    lines = read_gz_lines(spark, ref_logs)
    m = search(lines, SearchSpec(keywords=("ERROR",)))
    per_file = {r.file_path.rsplit("/", 1)[-1]: r["count"] for r in m.groupBy("file_path").count().collect()}
    assert per_file == {"app-2026-04-07-10.log.gz": 2, "app-2026-04-07-11.log.gz": 2,
                        "sys-2026-04-07-10.log.gz": 1}
    assert sum(per_file.values()) == 5


def test_matched_terms(spark, ref_logs):
    m = search(_file(spark, ref_logs, "app-2026-04-07-10.log.gz"), SearchSpec(keywords=("ERROR",))).collect()
    assert m
    for r in m:
        assert "ERROR" in r.matched_terms
        assert r.file_path and r.line_text


def test_union_of_roots(spark, ref_logs, tmpdir_path):
    from tests.conftest import APP_11, write_gz
    from logsift.sources.gzlogs import read_gz_roots
    other = f"{tmpdir_path}/other"
    write_gz(f"{other}/more.gz", APP_11)
    m = search(read_gz_roots(spark, [ref_logs, other]), SearchSpec(keywords=("ERROR",)))
    assert m.count() == 7
