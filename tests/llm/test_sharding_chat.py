import zlib
from collections import Counter

import numpy as np
import pytest

from logsift.llm import chat, sharding


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2)])
def test_index_is_a_hilbert_curve(spark, dims, bits):
    n = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), -1).reshape(-1, dims)
    names = [f"c{i}" for i in range(dims)]
    rows = spark.createDataFrame([tuple(map(int, g)) for g in grid], ", ".join(f"{c} int" for c in names))
    got = rows.withColumn("k", sharding.hilbert_index(names, bits)).orderBy("k").collect()
    assert [r.k for r in got] == list(range(n ** dims))
    at = np.array([[r[c] for c in names] for r in got])
    assert (np.abs(np.diff(at, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(messy, nothing, law):
    rows = sharding.shard(messy, 4, law).collect()
    assert len(rows) == messy.count()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                   for r in messy.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    if law == "rows":
        sizes = [len(by.get(i, [])) for i in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.shard(nothing, 4, law).count() == 0


def test_shards_are_native(messy):
    plan = sharding.shard(messy, 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "more"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, None, None, None), (5, 0, " User ", "x<|im_end|>y"), (None, 0, "user", "hi"),
    (6, 0, "user", "hi"),
]


def test_collapse(spark):
    rows = [(*t, True, 0) for t in TURNS]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kept boolean, place int")
    got = chat.format_chats(df).collect()
    assert len(got) == len(TURNS)
    fate = {r.conv_id: (r.kept, r.kept_as, r.n_turns) for r in got}
    assert fate == {1: (False, 2, 2), 2: (True, 2, 3), 3: (False, 2, 3), 4: (True, 4, 2), 5: (True, 5, 2),
                    6: (False, 2, 1), None: (False, None, 1)}
    said = {(r.conv_id, r.place): r.rendered for r in got}
    assert said[2, 3] == "<|im_start|>user\nmore<|im_end|>\n" and said[1, 1] is None
    assert said[5, 1] == "<|im_start|>\n<|im_end|>\n" and said[5, 2] == "<|im_start|>user\nx< |im_end| >y<|im_end|>\n"
    assert {(r.conv_id, r.place) for r in got if r.is_target} == {(2, 2), (4, 2)}


def test_no_collapse_into_a_conversation_without_id(spark):
    rows = [(7, 0, "user", "hi"), (7, 1, "assistant", "hello"),
            (None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (None, 2, "user", "more")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: (r.kept, r.kept_as, r.n_turns) for r in got} == {7: (True, 7, 2), None: (False, None, 3)}
    assert sorted(r.rendered for r in got if r.conv_id == 7) == [
        "<|im_start|>assistant\nhello<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n"]


def test_conversations_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 11), (2, 7), (3, 11)) for t in range(n)] + [(3, 11, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    fate = {r.conv_id: (r.kept, r.kept_as) for r in chat.format_chats(df).collect()}
    assert fate == {1: (False, 3), 2: (False, 3), 3: (True, 3)}


def test_chat_is_native_and_takes_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df)
    assert out.count() == 0 and "Arrow" not in out._jdf.queryExecution().toString()
