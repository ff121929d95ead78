"""One-shuffle numbering, filtered context, bitmaps, pruning that skips files, seeking."""
import functools
import os

import pytest
from pyspark.sql import functions as F

from logsift import engine as engine_module
from logsift.engine import LogEngine
from logsift.operators import bloom, candidates, context, keyfilter, minutes, numbering, search
from logsift.schemas import SearchSpec
from logsift.session import materialize
from logsift.streaming.live import search_gz_stream
from tests.conftest import APP_10, APP_11, SYS_10, lines_df, write_gz


@pytest.fixture()
def no_static_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("Exchange"), \
        df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def leaves(df):
    """The scans of an executed plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        elif p.children().isEmpty():
            found.append(p)
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return [p for p in found if p.getClass().getSimpleName() == "FileSourceScanExec"]


def metric(scan, name):
    return scan.metrics().apply(name).value()


def test_rows_are_numbered_in_one_shuffle(spark, no_static_broadcast):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("f"), F.col("id") % 7)).alias("file_path"),
        (F.col("id") * 7919 % 2000).alias("k"))
    got = numbering.number_rows(rows, ["k"], ["file_path"])
    assert shuffles(got)[1] == 0  # the range partitioning lies before the staged table
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file_path, r.k)):
        want.setdefault(r.file_path, []).append(r.k)
    assert {(r.file_path, r.line_number, r.k) for r in got.collect()} == {
        (f, i, k) for f, ks in want.items() for i, k in enumerate(ks, 1)}
    whole = numbering.number_rows(rows, ["k", "file_path"], [], out_col="n")
    assert shuffles(whole)[1] == 0 and sorted(r.n for r in whole.collect()) == list(range(1, 2001))


def test_contiguous_numbering_shuffles_no_row(spark, no_static_broadcast):
    tagged = materialize(spark.range(0, 50, 1, 1).select(F.floor(F.col("id") / 10).cast("string").alias("f"),
                                                F.monotonically_increasing_id().alias("p")), "t")
    got = numbering.number_contiguous(tagged, "f", "p")
    assert shuffles(got)[1] == 0 and sorted(r.line_number for r in got.collect()) == sorted([*range(1, 11)] * 5)


def test_a_side_beyond_its_bound_is_not_broadcast(spark, no_static_broadcast):
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert keyfilter.measured_bytes(rows) == 100 * 16 + 190
    big = spark.range(100).select(F.col("id").cast("string").alias("k"))
    for bound, wanted in ((10_000, True), (100, False)):
        plan = big.join(keyfilter.small_side(rows, "side", bound), "k")._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == wanted


@pytest.mark.parametrize("bits", [7, 12, 27])
def test_key_filter_drops_no_wanted_key(spark, bits):
    rows = spark.range(20_000).select("id", F.concat(F.lit("f"), F.col("id") % 11).alias("f"))
    wanted = rows.where("id % 97 = 0")
    kept = {r.id for r in keyfilter.KeyFilter(wanted, ["f", "id"], bits).keep(rows, ["f", "id"]).collect()}
    assert {i for i in range(0, 20_000, 97)} <= kept
    if bits == 27:
        assert len(kept) < 220  # 207 wanted
    empty = keyfilter.KeyFilter(rows.where("id < 0"), ["f"], bits).keep(rows, ["f"])
    assert empty.count() == 0


@pytest.mark.parametrize("c", [1, 2, 10])
def test_context_reads_lines_near_matches_only(spark, no_static_broadcast, c):
    text = [("hot" if i % 2 else f"f{i % 5}", f"line {i} {'ERROR' if i % 331 == 0 else 'ok'}") for i in range(4000)]
    lines = lines_df(spark, text).cache()
    m = search.search(lines, SearchSpec(keywords=("error",)))
    n = m.count()
    assert context.nearby_lines(lines, m, c).count() <= n * 2 * (2 * c + 1) + 5
    got = {(r.file_path, r.line_number): r for r in context.context_join(
        m, context.nearby_lines(lines, m, c), c).collect()}
    by = {}
    for r in lines.collect():
        by.setdefault(r.file_path, {})[r.line_number] = r.line
    assert len(got) == n
    for (f, k), r in got.items():
        assert r.context_lines == [by[f][x] for x in range(k - c, k + c + 1) if x in by[f]]
        assert r.context_start == max(k - c, 1) and r.line_text == by[f][k] and r.matched_terms == ["error"]


def test_bitmap_holds_the_positions(spark):
    lines = lines_df(spark, [("a", "one Two three"), ("a", "ONE four"), ("b", "five")])
    got = {}
    for r in bloom.build_blooms(lines).collect():
        got.setdefault(r.file_path, set()).update(64 * r.word + i for i in range(64) if r.bits >> i & 1)
    words = {"a": ["one", "two", "three", "four"], "b": ["five"]}
    assert got == {f: {p for of in bloom.positions_of(spark, ws) for p in of} for f, ws in words.items()}


def test_probe_reads_its_words_only(spark, tmpdir_path):
    lines = lines_df(spark, [(f"f{i}", " ".join(f"w{(i * 31 + j) % 2000}" for j in range(300))) for i in range(60)])
    path = bloom.write_blooms(bloom.build_blooms(lines), f"{tmpdir_path}/blooms", 8)
    found = bloom.probe(spark.read.parquet(path), ["w77"])
    assert "w77" and {r.file_path for r in found.collect()} >= {
        r.file_path for r in lines.where(F.col("line").rlike(r"\bw77\b")).collect()}
    assert "PushedFilters: [In(word" in found._jdf.queryExecution().executedPlan().toString()


def day_table(spark, path):
    rows = [(f"2026/04/{d:02d}/{h:02d}/app.log.gz", f"2026-04-{d:02d} {h:02d}:00:{s:02d} | {'ERROR' if (d, h) == (3, 5) else 'INFO'} x")
            for d in range(1, 9) for h in range(0, 24, 5) for s in range(20)]
    lines = lines_df(spark, rows).withColumn("dt", F.regexp_replace(F.substring("file_path", 1, 10), "/", "-"))
    lines.write.partitionBy("dt").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("most", [10_000, 0])
def test_candidates_prune_partitions(spark, tmpdir_path, most):
    lines = day_table(spark, f"{tmpdir_path}/lines")
    blooms = bloom.build_blooms(lines).cache()
    cands = candidates.candidate_files(lines, "2026-04-01", "2026-04-08", ["error"], "AND", blooms=blooms)
    assert [r.file_path for r in cands.collect()] == ["2026/04/03/05/app.log.gz"]
    got = candidates.scan_candidates(lines, cands, most=most)
    scans = [s for s in leaves(got) if "lines" in s.toString() or metric(s, "numFiles")]
    assert got.count() == 20
    assert max(metric(s, "numPartitions") for s in scans if s.metrics().contains("numPartitions")) == 1
    none = candidates.scan_candidates(lines, cands.where("false"), most=most)
    assert none.count() == 0


def test_gz_search_opens_candidates_only(spark, tmpdir_path, monkeypatch):
    logs = f"{tmpdir_path}/logs/2026/04/07"
    write_gz(f"{logs}/10/app one+.gz", APP_10)
    write_gz(f"{logs}/10/sys.gz", SYS_10)
    write_gz(f"{logs}/11/app.gz", APP_11)
    eng = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", root=f"{tmpdir_path}/engine")
    args = "2026-04-07 10:00", "2026-04-07 11:59", ["error", "bank:hdfc"], "AND"
    plain = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", root=f"{tmpdir_path}/none")
    want = sorted(map(str, plain.pruned_search(*args).collect()))
    assert len(want) == 1
    eng.build_indexes()
    index, blooms = eng.indexes()
    # the other files can't be read any more: opening one would fail
    strict = functools.partial(engine_module.read_gz_lines, ignore_corrupt=False)
    monkeypatch.setattr(engine_module, "read_gz_lines", strict)
    state = os.stat(f"{logs}/10/sys.gz")
    for name in ("10/sys.gz", "11/app.gz"):
        with open(f"{logs}/{name}", "wb") as f:
            f.write(b"not gzip at all")
    assert state.st_size
    for i, b in ((index, blooms), (index, None), (None, blooms)):
        fresh = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", root=f"{tmpdir_path}/engine")
        assert fresh.indexes() == (None, None)  # the logs have changed: stored ones don't count
        assert sorted(map(str, fresh.pruned_search(*args, index=i, blooms=b).collect())) == want
    with pytest.raises(Exception):
        LogEngine.from_gz(spark, f"{tmpdir_path}/logs").pruned_search(*args).collect()


def test_search_from_a_time_skips_row_groups(spark, tmpdir_path):
    rows = [("long.gz", f"2026-04-07 {i // 600:02d}:{i // 10 % 60:02d}:{i % 60:02d} | ERROR {i}") for i in range(9000)]
    rows += [("plain.gz", f"no time {i} ERROR") for i in range(50)]
    path = f"{tmpdir_path}/lines"
    (lines_df(spark, rows).coalesce(1).sortWithinPartitions("file_path", "line_number")
     .write.option("parquet.block.size", 8192).option("parquet.page.size", 1024)
     .option("parquet.block.size.row.check.min", 10).parquet(path))
    lines = spark.read.parquet(path)
    eng = LogEngine.from_table(spark, path, root=f"{tmpdir_path}/engine")
    spec = SearchSpec(keywords=("error",))
    got = eng.search_from(spec, "13:00")
    start = {r.file_path: r.start_line for r in minutes.seek_line(minutes.minute_index(lines), "13:00").collect()}
    assert start["long.gz"] == 7801 - 1000
    want = {(r.file_path, r.line_number) for r in search.search(lines, spec).collect()
            if r.line_number >= start.get(r.file_path, 0)}
    assert {(r.file_path, r.line_number) for r in got.collect()} == want and len(want) == 9000 - 6800 + 50
    few = minutes.lines_from(lines, minutes.minute_index(lines), "13:00", most=0)
    assert few.count() == len(want)
    assert "GreaterThanOrEqual(line_number,6801)" in got._jdf.queryExecution().executedPlan().toString()


def test_a_bad_file_does_not_end_the_stream(spark, tmpdir_path):
    src = f"{tmpdir_path}/in"
    write_gz(f"{src}/good one.gz", APP_10)
    write_gz(f"{src}/cut.gz", "\n".join(f"{i} ERROR {os.urandom(20).hex()}" for i in range(20_000)))
    with open(f"{src}/cut.gz", "rb") as f:
        half = f.read()[:200_000]
    with open(f"{src}/cut.gz", "wb") as f:
        f.write(half)
    with open(f"{src}/bad.gz", "wb") as f:
        f.write(b"this is not gzip")
    out = search_gz_stream(spark, f"{src}/*.gz", SearchSpec(keywords=("error",)), f"{tmpdir_path}/stream", max_files_per_trigger=1)
    rows = spark.read.parquet(out).collect()
    names = {r.file_path.rsplit("/", 1)[-1] for r in rows}
    assert names == {"good one.gz", "cut.gz"}
    cut = sorted(r.line_number for r in rows if r.file_path.endswith("cut.gz"))
    assert cut == list(range(1, len(cut) + 1)) and 100 < len(cut) < 20_000


def test_audit_tells_what_was_read(spark, tmpdir_path):
    import gzip

    from logsift.sources.gzlogs import read_gz_lines
    from logsift.sources.inventory import browse, scan_audit, scan_totals
    logs = f"{tmpdir_path}/logs"
    write_gz(f"{logs}/a b/app.gz", APP_10)
    write_gz(f"{logs}/a b/last.gz", "no newline at the end\r\nERROR")
    write_gz(f"{logs}/blank.gz", "")
    whole = gzip.compress("".join(f"{os.urandom(9).hex()}\n" for _ in range(30_000)).encode())
    for name, held in (("cut.gz", whole[:len(whole) // 2]), ("bad.gz", b"plain"), ("stub.gz", whole[:40]), ("note.txt", b"x")):
        with open(f"{logs}/{name}", "wb") as f:
            f.write(held)
    os.makedirs(f"{logs}/none")
    lines = read_gz_lines(spark, logs)
    audit = scan_audit(spark, logs, lines)
    got = {r.file_path.rsplit("/", 1)[-1]: r for r in audit.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "app.gz": "read", "last.gz": "read", "blank.gz": "empty", "cut.gz": "cut", "bad.gz": "unreadable", "stub.gz": "unreadable"}
    assert got["bad.gz"].reason == "not gzip" and got["stub.gz"].reason == "no line before the break"
    assert got["app.gz"].lines == 5 and got["cut.gz"].lines > 0
    t = scan_totals(audit, search.search(lines, SearchSpec(keywords=("error",)))).first()
    assert (t.files_total, t.files_searched, t.percent, t.matches_found) == (6, 4, 66, 3)
    assert t.searched_size == sum(os.path.getsize(f"{logs}/{n}") for n in ("a b/app.gz", "a b/last.gz", "blank.gz", "cut.gz"))
    entries = {r["name"]: (r.is_dir, r["size"], r.gz_count) for r in browse(spark, logs).collect()}
    assert entries["a b"] == (True, 0, 2) and entries["none"] == (True, 0, 0) and entries["note.txt"] == (False, 1, 0)
    assert browse(spark, f"{logs}/a b").where("gz_count > 0").count() == 0
