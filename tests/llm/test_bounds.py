"""Bounds and contracts: memory per batch, samples, hot rows, long common prefixes."""
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import chat, common, covertree, neardup, packing, sharding, tokenizing, toxicity, words


def plain_hash(raw: bytes) -> int:
    value = sum(int(words._BYTE[b]) * pow(words._MULT, i, 2**64) for i, b in enumerate(raw)) + len(raw)
    return int(words.mix(np.array([value % 2**64], np.uint64))[0])


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    text = b"one two " + b"x" * 70 + b" three 4 " + b"yz" * 9 + b" end"
    buf = np.frombuffer(text, np.uint8)
    s, e, _ = words.word_spans(buf, np.array([0, len(buf)]))
    want = [plain_hash(text[a:b]) for a, b in zip(s, e)]
    assert words.word_hashes(buf, s, e).tolist() == want
    words._powers.cache_clear()
    monkeypatch.setattr(words, "SLICE", 8)
    try:
        assert words.word_hashes(buf, s, e).tolist() == want
    finally:
        words._powers.cache_clear()


def test_batches_count_all_their_texts():
    rows = pa.RecordBatch.from_pydict({"a": ["x" * 10] * 6, "b": [None, "y" * 90, "", "z", "w" * 90, "v"]})
    ended = []
    parts = list(common.by_bytes(iter([rows]), ("a", "b"), 100, lambda: ended.append(1)))
    assert sum(p.num_rows for p in parts) == 6 and len(parts) >= 3 and ended == [1]


def test_encoder_remembers_a_bounded_number_of_parts(monkeypatch):
    enc = tokenizing.encoder("word_bpe_49k.json")
    enc.clear()
    monkeypatch.setattr(tokenizing, "MEMO_BYTES", 2000)
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    both = [tokenizing.encode_column(enc, pa.array([t]), counts_only=True)[0] for t in texts]
    assert len(enc.memo) < 200  # of 1,200
    enc.clear()
    assert not enc.memo and both == [tokenizing.encode_column(enc, pa.array([t]), counts_only=True)[0] for t in texts]


def test_sets_in_slices(monkeypatch):
    texts = pa.array([" ".join(f"t{(i * j) % 97}" for j in range(i)) for i in range(40)] + [None, ""])
    whole = neardup._sets(texts)
    monkeypatch.setattr(neardup, "BATCH_BYTES", 300)
    assert all(np.array_equal(a, b) for a, b in zip(whole, neardup._sets_in_slices(texts)))
    h, off = neardup._sets_in_slices(texts.slice(0, 0))
    assert not len(h) and off.tolist() == [0]


def test_links_of_large_groups_in_hash_slices(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHINGLES", 64)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:59 - i % 3] + [f"tail{i}"])) for i in range(40)]
    rows += [(100 + i, " ".join(base[30:] + base[:30 - i] + ["x"])) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = {k: new if v == old else v for k, v in comp.items()}
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == comp


def test_sample_stays_near_its_bound_when_one_id_has_many_texts(spark):
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    y = spark.createDataFrame([(5, 1)], "doc_id long, y int")
    assert 200 <= toxicity._sample(docs, y, 200).count() <= 220


def test_long_common_prefixes_keep_their_dimension(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"),
        F.concat(F.lit("https://example.org/"), (F.col("id") % 4).cast("string")).alias("source"))
    rows = sharding.shard(docs, 4).collect()
    by = Counter((r.shard, r.doc_id % 4) for r in rows)
    assert len(by) == 4 and set(by.values()) == {100}  # a shard for each source


def test_a_repeated_row_is_dealt_to_many_tasks(spark):
    docs = spark.range(600).select(
        F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") < 300, F.lit("the very same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    pieces = packing.pack(docs, seq_len=64).withColumn("p", F.spark_partition_id()).collect()
    sizes = Counter()
    for r in pieces:
        sizes[r.p] += r.length
    assert max(sizes.values()) <= 3 * sum(sizes.values()) / len(sizes)
    ends = sorted((r.sequence_id * 64 + r.offset, r.length) for r in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:])) and ends[0][0] == 0
    shards = Counter((r.shard, r.slot) for r in sharding.shard(docs, 6).collect())
    assert len(shards) == 600


def test_sql_of_chats_knows_null_ids(spark):
    rows = [(7, 0, "user", "hi"), (7, 1, "assistant", "hello"),
            (None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (None, 2, "user", "more")]
    conversations = pa.table({k: pa.array(v, t) for k, v, t in zip(  # noqa: F841  read by the SQL
        ("conv_id", "turn", "role", "text"), zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string()))})
    want = duckdb.sql(chat.SQL).fetchall()
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    order = duckdb.sql(chat.SQL).columns
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in order)) for r in got.collect())


def test_sums_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 3)
    rows = spark.range(0, 200, 1, 17).selectExpr("id % 2 as k", "id as n")
    sizes = spark.sparkContext.accumulator(0)

    def fold(t):
        assert t.num_rows <= 6  # two keys' rows of three tasks at most
        sizes.add(1)
        return {"n": pa.array([sum(t.column("n").to_pylist())], pa.int64())}

    parts = rows.mapInArrow(lambda batches: (
        pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "n": pa.array([sum(v)], pa.int64())})
        for b in batches for k in (0, 1)
        for v in [[n for q, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist()) if q == k]]), "k long, n long")
    got = common.merged(parts, fold, ("k",)).collect()
    assert 2 <= len(got) <= 4 and sizes.value > 2
    assert {k: sum(r.n for r in got if r.k == k) for k in (0, 1)} == {0: 9900, 1: 10000}
    assert common.merged(parts.where("k > 9"), fold, ("k",)).count() == 0


@pytest.mark.parametrize("sql, table, rows, run", [
    (covertree.SQL, "embeddings", [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, []), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 0.3]), (10, [1.0])], covertree.near_vectors),
    (neardup.SQL, "documents", [
        (1, "a b c d e f g h i j k l m n o p q r s t"), (2, "A b c d e f g h i j k l m n o p q r s t"),
        (2, "a b c d e f g h i j k l m n o p q r s t u"), (3, None), (4, ""), (5, " x\ty "), (6, "X  y"), (7, "x y z"),
        (None, "x y z"), (8, "b c d e f g h i j k l m n o p q r s t u v w x")], neardup.near_duplicates)])
def test_sql_of_pairs_on_odd_rows(spark, sql, table, rows, run):
    kind = "array<double>" if table == "embeddings" else "string"
    names = ("vec_id", "embedding") if table == "embeddings" else ("doc_id", "text")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE {table} ({names[0]} BIGINT, {names[1]} {'DOUBLE[]' if table == 'embeddings' else 'VARCHAR'})")
    con.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    cols = [c[0] for c in con.execute(sql).description]
    want = sorted(con.execute(sql).fetchall(), key=str)
    got = run(spark.createDataFrame(rows, f"{names[0]} long, {names[1]} {kind}")).select(cols).collect()
    assert sorted(map(tuple, got), key=str) == want
