"""Plan-shape checks: the scale properties the design relies on."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from logsift.operators import minutes, stats, tokens
from logsift.operators.context import context_join
from logsift.operators.search import search
from logsift.schemas import SearchSpec
from logsift.sources.hours import hour_folder_filter
from tests.conftest import lines_df


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


@pytest.fixture()
def table(spark, tmpdir_path):
    rows = []
    for day in ("01", "02", "03"):
        for h in ("09", "10", "11"):
            for i in range(5):
                rows.append((f"2026/04/{day}/{h}/app.log.gz",
                             f"2026-04-{day} {h}:{i:02d}:00 | {'ERROR' if i % 2 else 'INFO'} | USER:U{i} "
                             f"| ERROR_CODE:T{i % 3}"))
    df = lines_df(spark, rows).withColumn("dt", F.regexp_replace(F.substring("file_path", 1, 10), "/", "-"))
    path = f"{tmpdir_path}/lines"
    df.write.partitionBy("dt").parquet(path)
    return spark.read.parquet(path)


def test_search_is_one_stage_without_shuffle(table):
    p = plan(search(table, SearchSpec(keywords=("error",), exclude_keywords=("u3",))))
    assert "Exchange" not in p
    assert "ReadSchema: struct<file_path:string,line_number:bigint,line:string>" in p


def test_hour_range_prunes_partitions_and_row_groups(table):
    p = plan(table.where(hour_folder_filter("2026-04-02 10:30", "2026-04-02 11:00", dt=F.col("dt"))))
    assert "PartitionFilters: [isnotnull(dt" in p and "(dt#" in p
    assert "GreaterThanOrEqual(file_path,2026/04/02/10/)" in p
    assert "LessThan(file_path,2026/04/02/110)" in p


def test_top_k_is_limited_before_the_shuffle(table):
    p = plan(stats.top_facts(search(table, SearchSpec(keywords=("error",)))))
    assert "WindowGroupLimit" in p


def test_minute_index_uses_hash_aggregates(table):
    p = plan(minutes.minute_index(table))
    assert "SortAggregate" not in p


def test_index_lookup_pushes_in_list(spark, table, tmpdir_path):
    path = tokens.write_index(tokens.file_keywords(table), f"{tmpdir_path}/idx", 2)
    p = plan(tokens.files_for_keywords(spark.read.parquet(path), ["error", "info"], "AND"))
    assert "In(keyword, [error,info])" in p.split("PushedFilters:")[1].splitlines()[0]


def test_context_is_one_join_and_starts_no_job(spark, table):
    m = search(table, SearchSpec(keywords=("error",)))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    p = plan(context_join(m, table, 2))
    minutes.minute_index(table)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert p.split("== Physical Plan ==")[1].split("(1)")[0].count("Join") == 1
