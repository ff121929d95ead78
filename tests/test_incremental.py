"""Index kept fresh file by file, many saved searches, growing files and batch totals."""

import os
import time

import pytest
from pyspark.sql import functions as F

from logsift.operators import indexstore, saved
from logsift.operators.tokens import file_keywords
from logsift.schemas import SavedSearch, SearchSpec
from logsift.sources.gzlogs import raw_gz_lines
from logsift.streaming import growing, progress
from tests.conftest import APP_10, APP_11, CLEAN_10, SYS_10, lines_df, write_gz


def rows(df):
    return sorted(map(tuple, df.collect()))


def part_files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}"))
            for d in os.listdir(path) if d.startswith("bucket=")}


def test_refresh_rewrites_only_buckets_of_changed_files(spark, tmpdir_path):
    logs, root = f"{tmpdir_path}/logs", f"{tmpdir_path}/index"
    for name, text in {"a": APP_10, "b": APP_11, "c": SYS_10, "d": CLEAN_10}.items():
        write_gz(f"{logs}/2026/{name} 1.gz", text)
    with open(f"{logs}/bad.gz", "wb") as f:
        f.write(b"no gzip")
    first = indexstore.refresh_index(spark, logs, root)
    assert {r.status for r in first.collect()} == {"new"} and first.count() == 5
    whole = rows(file_keywords(raw_gz_lines(spark, logs)))
    assert rows(indexstore.read_index(spark, root)) == whole
    assert indexstore.indexed_files(spark, root).count() == 5  # the bad one is known, without keywords

    before = part_files(f"{root}/of-256")
    assert indexstore.refresh_index(spark, logs, root).count() == 0
    assert part_files(f"{root}/of-256") == before

    time.sleep(0.01)
    write_gz(f"{logs}/2026/b 1.gz", APP_11 + "2026-04-07 11:09:00 | ERROR | unheard\n")
    os.remove(f"{logs}/2026/c 1.gz")
    write_gz(f"{logs}/2026/e.gz", "fresh words\n")
    changes = indexstore.refresh_index(spark, logs, root)
    assert {(r.file_path.rsplit("/", 1)[-1], r.status) for r in changes.collect()} == {
        ("b 1.gz", "changed"), ("c 1.gz", "deleted"), ("e.gz", "new")}
    assert rows(indexstore.read_index(spark, root)) == rows(file_keywords(raw_gz_lines(spark, logs)))
    after = part_files(f"{root}/of-256")
    touched = {f"bucket={r.b}" for r in changes.select(indexstore._bucket(256).alias("b")).collect()}
    assert {d for d in after if after[d] != before.get(d)} == touched
    assert len(touched) < len(after)


def test_refresh_beyond_a_list_of_files_and_a_touched_time(spark, tmpdir_path, monkeypatch):
    logs, root = f"{tmpdir_path}/logs", f"{tmpdir_path}/index"
    for i in range(6):
        write_gz(f"{logs}/{i}.gz", f"word{i} same\n")
    monkeypatch.setattr(indexstore, "listed", lambda files: (files, None))
    indexstore.refresh_index(spark, logs, root, buckets=3)
    os.utime(f"{logs}/2.gz", (1, 1))  # another time, older than before
    changes = indexstore.refresh_index(spark, logs, root, buckets=3)
    assert [(r.file_path[-4:], r.status) for r in changes.collect()] == [("2.gz", "changed")]
    assert rows(indexstore.read_index(spark, root, buckets=3)) == rows(file_keywords(raw_gz_lines(spark, logs)))
    for i in range(6):
        os.remove(f"{logs}/{i}.gz")
    assert indexstore.refresh_index(spark, logs, root, buckets=3).count() == 6
    assert indexstore.read_index(spark, root, buckets=3).count() == 0


def by_predicates(lines, table):
    """The predicate form, however long the list."""
    return saved.apply_saved(lines, table)


def test_many_searches_equal_predicates(spark):
    lines = lines_df(spark, [("/x/a.gz", "ERROR timeout bank:sbi"), ("/x/a.gz", ""), ("/x/a.gz", None),
                             ("/x/b.gz", "errors and Ünïcode 😀 café"), ("file:/y/c.gz", "aaa a b ab"),
                             ("/x/b.gz", "timeout" * 500), ("/x/a.gz", "ERROR timeout bank:sbi")])
    words = ["error", "TIMEOUT", "a", "ab", "😀", "n😀", "😀 c", "ü", "café", "bank:sbi", " ", "out", "timeouttimeout", "zzz"]
    found = []
    for i, w in enumerate(words):
        for j, v in enumerate(words):
            for mode, path in (("AND", ""), ("OR", "/x/"), ("or", "/x/a.gz"), ("OR", "file:///y")):
                keys = [w, v, w.upper()] if w.strip() and v.strip() else ["none"]
                found.append(SavedSearch(f"{i}-{j}-{mode}-{path}", "", tuple(keys), mode, path, ""))
    found.append(SavedSearch("no keywords", "", (), "OR", "", ""))
    found.append(found[0])  # the same id twice gives its rows twice
    assert len(found) > saved.CHUNK
    many = rows(saved.apply_saved(lines, saved.saved_table(spark, found)).select("search_id", "file_path", "line_number"))
    want = []
    for k in range(0, len(found), 200):
        part = saved.saved_table(spark, found[k:k + 200])
        want += by_predicates(lines, part).select("search_id", "file_path", "line_number").collect()
    assert many == sorted(map(tuple, want)) and len(many) > 500
    with pytest.raises(ValueError):
        saved.apply_many(lines, saved.saved_table(spark, [SavedSearch("x", "", ("ok", " "), "OR", "", "")]))
    assert saved.apply_many(lines, saved.saved_table(spark, [])).collect() == []


def test_many_searches_take_unshared_grams_and_one_scan(spark, tmpdir_path):
    table = saved.saved_table(spark, [SavedSearch(str(i), "", (f"common prefix {i:04d}",), "OR", "", "") for i in range(1000)])
    per = saved.search_grams(table).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert per <= 150  # "com" would find all thousand
    lines_df(spark, [("a", "common prefix 0007"), ("a", "common prefix")]).write.parquet(f"{tmpdir_path}/l")
    out = saved.apply_saved(spark.read.parquet(f"{tmpdir_path}/l"), table)
    assert [(r.search_id, r.line_number) for r in out.collect()] == [("7", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("line_number") and plan.count("Union") == 0
    assert plan.count("file_path#") and plan.count("Relation [file_path") == 1


def test_growing_files_are_numbered_with_context(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(growing, "SNAPSHOT_EVERY", 2)
    src, root = f"{tmpdir_path}/src", f"{tmpdir_path}/out"
    spec = SearchSpec(keywords=("hit",), context_lines=2)
    text = {f: [f"{f} {i} {'hit' if i % 3 == 0 or f == 'b' else ''}" for i in range(23)] for f in "abc"}
    text["c"][5] = None  # a null line counts and matches nothing
    cuts = {"a": [0, 1, 2, 2, 10, 23], "b": [0, 9, 9, 9, 9, 23], "c": [0, 0, 20, 21, 22, 23]}
    read = []
    for k in range(5):
        new = [(f, i, text[f][i]) for f in "abc" for i in range(cuts[f][k], cuts[f][k + 1])]
        read.append(len(new))
        spark.createDataFrame(new, "file_path string, at long, line string").repartition(3).write.mode("append").parquet(src)
        stream = spark.readStream.schema("file_path string, at long, line string").parquet(src)
        growing.search_growing(stream, spec, ["at"], root)
        growing.search_growing(stream, spec, ["at"], root)  # nothing new: nothing written
        want = []
        for f in "abc":
            known = text[f][:cuts[f][k + 1]]
            for i, line in enumerate(known):
                if line and "hit" in line:
                    around = [x for x in known[max(i - 2, 0):i + 3]]
                    want.append((f, i + 1, max(i - 1, 1), [x for x in around if x is not None]))
        got = [(r.file_path, r.line_number, r.context_start, [x for x in r.context_lines if x is not None])
               for r in growing.growing_matches(spark, root).collect()]
        assert sorted(got) == sorted(want)
    assert sum(read) == 69
    # a batch that is run again writes the same rows
    before = rows(spark.read.parquet(f"{root}/data").select("file_path", "line_number", "batch"))
    last = spark.createDataFrame(new, "file_path string, at long, line string")
    growing.write_batch(last, 4, spec, ["at"], root)
    assert rows(spark.read.parquet(f"{root}/data").select("file_path", "line_number", "batch")) == before
    with pytest.raises(ValueError):
        growing.search_growing(stream, SearchSpec(keywords=("x",), max_matches=1), ["at"], root)


def test_batch_totals_equal_the_matches(spark, tmpdir_path):
    src, root = f"{tmpdir_path}/in", f"{tmpdir_path}/out"
    for name, text in {"a": APP_10, "b": APP_11, "c": SYS_10}.items():
        write_gz(f"{src}/{name}.gz", text)
    spec = SearchSpec(keywords=("error",))

    def run():
        lines = (spark.readStream.option("maxFilesPerTrigger", 1).text(f"{src}/*.gz")
                 .selectExpr("_metadata.file_path AS file_path", "value AS line"))
        return progress.search_with_progress(lines, spec, root, "totals-test")

    totals = run()
    assert totals.count() == 3
    assert totals.agg(F.sum("lines_scanned"), F.sum("matches_found")).first()[:] == (10, 5)
    write_gz(f"{src}/d.gz", CLEAN_10)
    assert run().agg(F.count("*"), F.sum("lines_scanned"), F.sum("matches_found")).first()[:] == (4, 11, 5)
    assert spark.read.parquet(f"{root}/data").count() == 5
    assert run().count() == 4


def test_pruned_search_over_a_refreshed_index(spark, tmpdir_path):
    from logsift.engine import LogEngine
    logs = f"{tmpdir_path}/logs"
    for hour, text in {"10": APP_10, "11": APP_11}.items():
        write_gz(f"{logs}/2026/04/07/{hour}/app.gz", text)
    eng = LogEngine.from_gz(spark, logs, f"{tmpdir_path}/engine")

    def found():
        hits = eng.pruned_search("2026-04-07 10:00", "2026-04-07 12:00", ["ERROR_CODE:TIMEOUT"], index=eng.refresh_index())
        return sorted((r.file_path[-9:], r.line_number) for r in hits.collect())

    assert found() == [("10/app.gz", 4), ("11/app.gz", 3)]
    time.sleep(0.01)
    write_gz(f"{logs}/2026/04/07/11/app.gz", APP_11 + "2026-04-07 11:10:00 | ERROR | ERROR_CODE:TIMEOUT\n")
    write_gz(f"{logs}/2026/04/07/12/app.gz", "2026-04-07 12:00:00 | ERROR | ERROR_CODE:TIMEOUT\n")
    os.remove(f"{logs}/2026/04/07/10/app.gz")
    assert found() == [("11/app.gz", 3), ("11/app.gz", 4), ("12/app.gz", 1)]


def test_a_saved_list_that_was_not_finished_is_not_read(spark, tmpdir_path):
    from logsift.engine import LogEngine
    eng = LogEngine(spark, lines_df(spark, [("a", "error")]), f"{tmpdir_path}/engine")
    first = eng.add_saved("one", ["error"])
    eng.add_saved("two", ["warn"])
    version = eng._saved_version()
    os.makedirs(f"{eng._saved_path}/v={version + 1}")  # a write that was cut off
    assert sorted(r.name for r in eng.saved_searches().collect()) == ["one", "two"]
    eng.delete_saved(first.id)
    eng.add_saved("three", ["info"])
    assert sorted(r.name for r in eng.saved_searches().collect()) == ["three", "two"]


def test_another_time_zone_has_its_own_key(spark, tmpdir_path):
    from logsift.sources.tables import _source_key
    spark.range(1).write.parquet(f"{tmpdir_path}/t")
    before = _source_key(spark, f"{tmpdir_path}/t")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert _source_key(spark, f"{tmpdir_path}/t") != before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert _source_key(spark, f"{tmpdir_path}/t") == before


def test_many_searches_meet_a_line_only_by_their_own_path_and_keyword(spark):
    """What is joined to the searches is in proportion to the matches, not to searches x lines."""
    searches = [SavedSearch(f"f{i}", "", ("timeout", "sbi"), "OR", f"/logs/{i}/app.gz", "") for i in range(300)]
    searches += [SavedSearch(f"u{i}", "", (f"USER:USR{i} |",), "AND", "", "") for i in range(2000)]
    lines = lines_df(spark, [(f"/logs/{i}/app.gz", f"timeout | USER:USR{i} | sbi timeout") for i in range(300)])
    made = []
    kept = saved.KeyFilter.keep
    try:
        saved.KeyFilter.keep = lambda self, rows, key: made.append(kept(self, rows, key)) or made[-1]
        out = rows(saved.apply_many(lines, saved.saved_table(spark, searches)).select("search_id", "file_path"))
    finally:
        saved.KeyFilter.keep = kept
    path = [f"/logs/{i}/app.gz" for i in range(300)]
    assert out == sorted([(f"f{i}", path[i]) for i in range(300)] + [(f"u{i}", path[i]) for i in range(300)])
    assert made[-1].count() <= 300 * 8  # 300 x 300 searches shared a line's grams before
    per = saved.search_grams(saved.saved_table(spark, searches)).groupBy("gram", "scope").count().agg(F.max("count")).first()[0]
    assert per <= 15


def test_many_searches_at_scopes_and_odd_signs(spark):
    lines = lines_df(spark, [("/", "\ufefferror x"), ("/a/b", "\U0001f600 error error"), ("hdfs://h:1/a/b", "ERRORs"),
                             ("rel/a.gz", "an error"), ("file:/y", "errors"), (None, "error"), ("", "error")])
    paths = ["", "/", "//", "/a", "/a/b/", "hdfs://h:1/a", "rel", "rel/", "re", "file:///y", "file:/", "/y"]
    found = [SavedSearch(f"{i}{mode}", "", ("error",), mode, p, "") for i, p in enumerate(paths) for mode in ("AND", "OR")]
    table = saved.saved_table(spark, found)

    def got(df):
        return sorted((r.search_id, str(r.file_path), r.line) for r in df.collect())

    assert got(saved.apply_many(lines, table)) == got(saved.apply_saved(lines, table)) != []
