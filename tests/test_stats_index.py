import random

from pyspark.sql import functions as F

from logsift.operators import bloom, stats, tokens
from logsift.operators.candidates import candidate_files, scan_candidates
from logsift.operators.search import search
from logsift.schemas import SearchSpec
from tests.conftest import lines_df


def test_stats_counts_duplicates_ties_and_timeline(spark):
    rows = [
        ("a", "2026-04-07 10:00:00 | ERROR | USER:U1 | API:/pay | BANK:SBI | ERROR_CODE:T | ERROR_CODE:T"),
        ("a", "2026-04-07 10:30:00 | ERROR | USER:U2 | API:/pay | BANK:HDFC | ERROR_CODE:A"),
        ("a", "2026-04-07 23:00:00 | ERROR |  USER:U2 | API:/login"),
        ("a", "2026-04-07 99:00:00 | ERROR | bad hour"),
        ("a", "short error"),
    ]
    m = search(lines_df(spark, rows), SearchSpec(keywords=("ERROR", "zzz", "error")))
    got = {(r.dim, r.label): (r.cnt, r.rk) for r in stats.top_facts(m).collect()}
    assert got[("error_codes", "T")] == (2, 1)          # counted twice in one line
    assert got[("error_codes", "A")] == (1, 2)
    assert got[("banks", "HDFC")] == (1, 1) and got[("banks", "SBI")] == (1, 2)  # tie: label order
    assert got[("top_users", "U2")] == (2, 1)           # Unicode space trimmed
    assert got[("timeline", "10:00")] == (2, 1) and got[("timeline", "23:00")] == (1, 2)
    assert ("timeline", "99:00") not in got
    assert got[("matched_terms", "ERROR")] == (5, 1) and got[("matched_terms", "error")] == (5, 2)


def test_stats_top_k_limits(spark):
    rows = [("a", f"2026-04-07 10:00:00 | ERROR | USER:U{i % 15:02d}") for i in range(100)]
    m = search(lines_df(spark, rows), SearchSpec(keywords=("error",)))
    users = stats.dimension(m, "top_users").orderBy("rk").collect()
    assert len(users) == 10 and users[0].cnt == 7 and users[0].label == "U00"


def test_token_index_rules(spark):
    rows = [("f1", "Hello, World!  (ab) \"quoted\" é… ÉÉ"), ("f2", "hello hello {xyz}")]
    idx = {(r.file_path, r.keyword) for r in tokens.file_keywords(lines_df(spark, rows)).collect()}
    # 'ab' too short; 'éé' is 4 bytes so it counts
    assert idx == {("f1", "hello"), ("f1", "world"), ("f1", "quoted"), ("f1", "é…"), ("f1", "éé"),
                   ("f2", "hello"), ("f2", "xyz")}


def test_files_or_and_equal_set_forms(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(f"f{i % 9}", " ".join(rnd.choice(words) for _ in range(3))) for i in range(60)]
    idx = tokens.file_keywords(lines_df(spark, rows))
    kws = ["Alpha", "beta", "alpha"]
    f_or = {r.file_path for r in tokens.files_for_keywords(idx, kws, "OR").collect()}
    f_and = {r.file_path for r in tokens.files_for_keywords(idx, kws, "AND").collect()}
    assert f_or == {r.file_path for r in tokens.files_union(idx, kws).collect()}
    assert f_and == {r.file_path for r in tokens.files_intersect(idx, kws).collect()}
    assert f_and <= f_or


def test_bloom_no_false_negatives_and_size(spark):
    rnd = random.Random(5)
    rows = [(f"f{i % 4}", " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(8))) for i in range(400)]
    lines = lines_df(spark, rows)
    blooms = bloom.build_blooms(lines).cache()
    assert bloom.BLOOM_BITS == 95851 and bloom.BLOOM_HASHES == 7
    present = {}
    for fp, line in rows:
        present.setdefault(fp, set()).update(line.lower().split())
    for fp, words in present.items():
        assert fp in {r.file_path for r in bloom.probe(blooms, sorted(words)[:25], "AND").collect()}
    absent = [f"zz{i}" for i in range(20)]
    false_pos = sum(bloom.probe(blooms, [w]).count() for w in absent)
    assert {r.file_path for r in bloom.probe(blooms, absent[:1] + ["w1"], "OR").collect()} >= {
        fp for fp, words in present.items() if "w1" in words}
    assert false_pos < 8  # 4 filters x 20 probes at ~1% or less


def test_candidates_and_scan(spark):
    rows = []
    for h in ("09", "10", "11", "12"):
        rows.append((f"2026/04/07/{h}/app.gz", f"2026-04-07 {h}:00:00 ERROR bank:sbi"))
        rows.append((f"2026/04/07/{h}/sys.gz", f"2026-04-07 {h}:00:00 INFO bank:sbi"))
    lines = lines_df(spark, rows)
    idx = tokens.file_keywords(lines)
    c = candidate_files(lines, "2026-04-07 10:45", "2026-04-07 11:15", ["error", "bank:sbi"], "AND", index=idx)
    assert sorted(r.file_path for r in c.collect()) == ["2026/04/07/10/app.gz", "2026/04/07/11/app.gz"]
    assert scan_candidates(lines, c).count() == 2


def test_replace_and_stale(spark):
    old = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "file_path string, keyword string")
    new = spark.createDataFrame([("a", "q")], "file_path string, keyword string")
    assert sorted(tuple(r) for r in tokens.replace_files(old, new).collect()) == [("a", "q"), ("b", "z")]
    inv = spark.createDataFrame([("a", 5), ("b", 1), ("c", 2)], "file_path string, modified long")
    built = spark.createDataFrame([("a", 3), ("b", 3)], "file_path string, built_at long")
    assert sorted(r.file_path for r in tokens.stale_files(inv, built).collect()) == ["a", "c"]


def test_write_index_roundtrip(spark, tmpdir_path):
    rows = [("f1", "alpha beta"), ("f2", "beta gamma")]
    path = tokens.write_index(tokens.file_keywords(lines_df(spark, rows)), f"{tmpdir_path}/idx", 2)
    back = spark.read.parquet(path)
    assert {r.file_path for r in tokens.files_for_keywords(back, ["beta"]).collect()} == {"f1", "f2"}


def test_fields_split_on_every_unicode_space(spark):
    from logsift.functions.text import WS_CHARS, explode_fields, fields
    text = "a" + "".join(f"{ch}t{i}" for i, ch in enumerate(WS_CHARS)) + "  　end "
    df = spark.createDataFrame([(text,)], "line string")
    expect = ["a"] + [f"t{i}" for i in range(len(WS_CHARS))] + ["end"]
    assert df.select(fields(F.col("line")).alias("f")).collect()[0].f == expect
    assert [r.token for r in explode_fields(df, "line", []).collect()] == expect


def test_tokens_are_told_apart_in_parts_that_grow_with_the_bytes(spark, tmpdir_path, monkeypatch):
    """A task's share stays the same however large the table is, with the same rows."""
    from logsift.sources import tables
    texts = [(i % 40, f"src{i % 3}" if i % 7 else None, "\n".join(f"Word{i % 5} same {k}.. w{i * k}" for k in range(20)))
             for i in range(120)] + [(1, "src1", None), (2, "src2", "")]
    spark.createDataFrame(texts, "doc_id long, source string, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    monkeypatch.setattr(tables, "PART_BYTES", 1000)
    lines = spark.read.parquet(tables.ingest_document_lines(spark, tmpdir_path, f"{tmpdir_path}/lines"))
    total = sum(len(t or "") for _, _, t in texts)
    assert tables.parts_of(spark.read.parquet(f"{tmpdir_path}/documents.parquet"), "text") == -(-total // 1000) > 30
    assert len(set(lines.inputFiles())) > 20  # 8 before, whatever the size
    monkeypatch.setattr(tokens, "DOC_CHUNK_LINES", 7)  # files of several chunks
    parts = tokens.index_parts(lines)
    found = tokens.file_keywords(lines, parts)
    assert parts > 30 and found.rdd.getNumPartitions() == parts
    assert sorted(map(str, found.collect())) == sorted(map(str, tokens.file_keywords(lines).collect()))


def test_an_index_spreads_a_keyword_of_every_file(spark, tmpdir_path):
    rows = [(f"f{i:04d}", "everywhere") for i in range(2000)]
    path = tokens.write_index(tokens.file_keywords(lines_df(spark, rows)), f"{tmpdir_path}/idx", 4)
    assert len(set(spark.read.parquet(path).inputFiles())) == 4  # one file, written by one task, before
