import os

import pytest

from logsift.schemas import SearchSpec
from logsift.streaming.live import file_counts_stream, run_state_table, search_gz_stream, totals_of
from tests.conftest import APP_10, APP_11, SYS_10, write_gz


def test_gz_stream_numbers_lines_per_batch(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    write_gz(f"{src}/app-10.gz", APP_10)
    write_gz(f"{src}/app-11.gz", APP_11)
    root = f"{tmpdir_path}/stream"
    out = search_gz_stream(spark, f"{src}/*.gz", SearchSpec(keywords=("error",)), root,
                           max_files_per_trigger=1)
    got = sorted((r.file_path.rsplit("/", 1)[-1], r.line_number) for r in spark.read.parquet(out).collect())
    assert got == [("app-10.gz", 2), ("app-10.gz", 4), ("app-11.gz", 1), ("app-11.gz", 3)]
    # a new file arrives: only it is processed on the next run
    write_gz(f"{src}/sys-10.gz", SYS_10)
    search_gz_stream(spark, f"{src}/*.gz", SearchSpec(keywords=("error",)), root)
    got = sorted((r.file_path.rsplit("/", 1)[-1], r.line_number) for r in spark.read.parquet(out).collect())
    assert ("sys-10.gz", 1) in got and len(got) == 5


def test_stream_totals_state(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    write_gz(f"{src}/a.gz", APP_10)
    write_gz(f"{src}/b.gz", APP_11)
    lines = (spark.readStream.option("maxFilesPerTrigger", 1).text(f"{src}/*.gz")
             .selectExpr("_metadata.file_path AS file_path", "value AS line"))
    path = run_state_table(file_counts_stream(lines, SearchSpec(keywords=("error",))), f"{tmpdir_path}/st")
    t = totals_of(spark.read.parquet(path)).collect()[0]
    assert (t.files_total, t.lines_scanned, t.matches_found) == (2, 8, 4)


def test_entry_contract(spark):
    import __spark_entry__ as E
    if not os.path.exists("/root/testdata/sf0.001/events.parquet"):
        pytest.skip("driver test data not present")
    df = E.entry(spark)
    assert df.columns == ["file_path", "line_number", "line_text", "matched_terms"]
    df.collect()
    assert set(E.queries()) >= set(E.oracle_sql())
