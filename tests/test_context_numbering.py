"""Skew-safe forms against brute force: numbering with one hot file, J1 = W2 with
small blocks (halo crossing), minute index with small blocks."""

import random

from pyspark.sql import functions as F

from logsift.operators.context import context_join, context_window
from logsift.operators.minutes import minute_index, seek_line
from logsift.operators.numbering import number_rows
from logsift.operators.search import search
from logsift.schemas import SearchSpec
from tests.conftest import lines_df


def test_number_rows_hot_group(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        f = "hot" if i % 3 == 0 or i < 500 else f"f{rnd.randint(0, 20)}"
        rows.append((f, rnd.randint(0, 10**6), i))
    df = spark.createDataFrame(rows, "file_path string, ts long, id long")
    expect = {}
    for f in {r[0] for r in rows}:
        for n, (ts, i) in enumerate(sorted((ts, i) for ff, ts, i in rows if ff == f), 1):
            expect[i] = n
    for strategy in ("range", "window"):
        out = number_rows(df, ["ts", "id"], ["file_path"], partitions=16, strategy=strategy).collect()
        assert {r.id: r.line_number for r in out} == expect, strategy


def test_number_rows_global_desc(spark):
    df = spark.createDataFrame([(f"f{i % 5}", i) for i in range(200)], "file_path string, line_number long")
    out = number_rows(df, [F.col("file_path").desc(), F.col("line_number").asc()], [],
                      out_col="result_no", partitions=7).collect()
    expect = sorted([(f"f{i % 5}", i) for i in range(200)], key=lambda t: (-int(t[0][1:]), t[1]))
    got = sorted(out, key=lambda r: r.result_no)
    assert [(r.file_path, r.line_number) for r in got] == expect
    assert [r.result_no for r in got] == list(range(1, 201))


def _brute_context(rows, c, hits):
    by_file = {}
    for fp, line in rows:
        by_file.setdefault(fp, []).append(line)
    out = {}
    for fp, lines in by_file.items():
        for n, line in enumerate(lines, 1):
            if hits(line):
                lo = max(1, n - c)
                out[(fp, n)] = (lo, lines[lo - 1:n + c])
    return out


def test_context_join_equals_window_and_brute(spark):
    rnd = random.Random(3)
    rows = [(f"f{i % 3}", f"line {i} {'ERR' if rnd.random() < 0.2 else 'ok'}") for i in range(300)]
    lines = lines_df(spark, rows)
    spec = SearchSpec(keywords=("err",), context_lines=3)
    j = {(r.file_path, r.line_number): (r.context_start, r.context_lines)
         for r in context_join(search(lines, spec), lines, 3).collect()}
    w = {(r.file_path, r.line_number): (r.context_start, r.context_lines)
         for r in context_window(lines, 3, block_lines=7).where(F.lower("line").contains("err")).collect()}
    brute = _brute_context(rows, 3, lambda l: "err" in l.lower())
    assert j == brute
    assert w == brute


def test_context_clamped(spark):
    rows = [("a", f"l{i}") for i in range(40)]
    lines = lines_df(spark, rows)
    r = context_join(search(lines, SearchSpec(keywords=("l20",), context_lines=50)), lines, 50).collect()[0]
    assert r.context_start == 11 and len(r.context_lines) == 21


def test_minute_index_blocks_and_seek(spark):
    rows = []
    minutes = ["10:00", "10:00", None, "10:01", None, None, "10:01", "10:02", "10:00", None, "10:03"] * 30
    for i, m in enumerate(minutes):
        rows.append(("a", f"2026-04-07 {m}:00 x" if m else f"no time {i}"))
    rows.append(("b", "11:30:00 starts with time"))
    lines = lines_df(spark, rows)
    got = sorted((r.file_path, r.line_number, r.minute) for r in minute_index(lines, block_lines=4).collect())
    expect, last = [], None
    for n, m in enumerate(minutes, 1):
        if m and m != last:
            expect.append(("a", n, m))
        if m:
            last = m
    expect.append(("b", 1, "11:30"))
    assert got == sorted(expect)
    idx = minute_index(lines, block_lines=4)
    assert {r.file_path: r.start_line for r in seek_line(idx, "10:01").collect()} == {"a": 0, "b": 0}
    assert {r.file_path: r.start_line for r in seek_line(idx, "").collect()} == {"a": 0, "b": 0}


def test_seek_line_margin(spark):
    idx = spark.createDataFrame([("a", "10:00", 1), ("a", "10:05", 1500), ("a", "10:10", 3000),
                                 ("b", "12:00", 5)], "file_path string, minute string, line_number long")
    got = {r.file_path: r.start_line for r in seek_line(idx, "10:07").collect()}
    assert got == {"a": 500, "b": 0}
    got = {r.file_path: r.start_line for r in seek_line(idx, "23:59").collect()}
    assert got == {"a": 2000, "b": 0}


def test_search_attaches_context(spark):
    rows = [("a", f"l{i} {'hit' if i in (0, 5, 9) else ''}") for i in range(10)]
    m = search(lines_df(spark, rows), SearchSpec(keywords=("hit",), context_lines=1))
    got = {r.line_number: (r.context_start, r.context_lines) for r in m.collect()}
    assert got[1] == (1, ["l0 hit", "l1 "])
    assert got[10] == (9, ["l8 ", "l9 hit"])
