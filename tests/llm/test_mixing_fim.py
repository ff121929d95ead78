import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.llm import fim, mixing


def brute_targets(sizes, weights=(1, 2, 3), repeats=3):
    """Shares the total by weight, again and again, until no target is above its cap."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole >= repeats * sizes[s]}
        for s in over or open_:
            target[s] = repeats * sizes[s] if over else left * weight[s] / whole
        left -= sum(target[s] for s in over or open_)
        open_ -= over or set(open_)
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2, "d": 50}, {"a": 5}, {"a": 0, "b": 0},
    {"a": 7, "b": 0, "c": 90, "d": 3, "e": 3, "f": 400}])
def test_budgets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "place string, source_size long")
    got = {r.place: r for r in mixing.budgets(rows).collect()}
    want = brute_targets(sizes)
    for s, r in got.items():
        assert r.target == pytest.approx(want[s]) and r.quota == int(r.target + 1e-9)
        assert r.target <= 3 * sizes[s] and r.epochs * sizes[s] + r.rest == r.quota


def sources(spark, n=300, hot=0.5):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = " ".join("wd" * int(rng.integers(1, 4)) for _ in range(int(rng.integers(0, 60))))
        rows.append((i, words, None if i % 17 == 0 else "big" if rng.random() < hot else f"s{i % 4}"))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix_fills_the_targets(spark):
    docs = sources(spark)
    rows = mixing.mix(docs).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == size
    by = defaultdict(list)
    for r in rows:
        by[source[r.doc_id]].append(r)
        assert 0 <= r.taken <= 3 * r.size and r.epochs * r.size <= r.taken <= (r.epochs + 1) * r.size
    order = sorted((s for s in by if s is not None)) + [None]
    want = brute_targets({s: sum(r.size for r in by[s]) for s in order})
    for s in order:
        assert by[s][0].target == pytest.approx(want[s])
        assert sum(r.taken for r in by[s]) == int(by[s][0].target + 1e-9)
        partly = [r for r in sorted(by[s], key=lambda r: r.key) if r.size]
        share = [(r.taken - r.epochs * r.size) / r.size for r in partly]
        assert share == sorted(share, reverse=True)  # the first in order of their keys
        assert sum(0 < x < 1 for x in share) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_whole_documents(spark):
    rows = mixing.mix(sources(spark), split_last=False).collect()
    assert all(r.taken in (r.epochs * r.size, (r.epochs + 1) * r.size) for r in rows)


def test_better_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("s").alias("source"))
    good = F.when(F.col("doc_id") % 2 == 0, F.lit(9.0)).otherwise(F.lit(1.0))
    rows = sorted(mixing.mix(docs, weight=good).collect(), key=lambda r: r.key)[:400]
    assert 0.85 < sum(r.doc_id % 2 == 0 for r in rows) / 400 < 0.95  # 0.9 of the first draws


def test_mix_of_odd_rows(messy, nothing):
    rows = mixing.mix(messy).collect()
    assert len(rows) == messy.count() and mixing.mix(nothing).count() == 0
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert all(r.taken == 0 for r in rows if r.doc_id in (3, 4, 8))
    assert mixing.mix(messy.drop("source").withColumn("source", F.lit(None))).count() == len(rows)


def test_a_repeated_row_is_spread(spark):
    docs = spark.range(900).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("one two three").alias("text"),
        F.lit("s").alias("source"))
    rows = mixing.mix(docs).collect()
    assert sum(r.taken for r in rows) == 2700 and sum(r.doc_id == 1 for r in rows) == 400


def test_mix_is_native(messy):
    plan = mixing.mix(messy)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_tree_finds_every_unit(counts):
    counts = np.array([(u, u + p) for u, p in counts], np.int64)
    tree = fim.BlockTree(counts)
    assert tree.total() == tuple(counts.sum(0))
    block = np.repeat(np.arange(len(counts)), counts[:, 0])
    for k, b in enumerate(block):
        at, left, points = tree.find(k)
        assert (at, left, points) == (b, k - counts[:b, 0].sum(), counts[:b, 1].sum())


def parts(text, unit):
    if unit == "codepoint":
        return list(text)
    return re.findall(r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", text)


def brute_fim(doc_id, text, unit="codepoint"):
    text = text or ""
    units = parts(text, unit)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    u, v = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if h4 % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,block", [("codepoint", 4096), ("codepoint", 3), ("word", 4096), ("word", 5)])
def test_fim_against_brute_force(spark, unit, block):
    rng = np.random.default_rng(1)
    alphabet = list("ab é日𝄞 \n\t<>PSM")
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 80)))) for _ in range(300)]
    texts += ["a<P>b", "<S", "ends<", None, "", "   ", "é", "日本 語 " * 5000]
    rows = list(enumerate(texts)) + [(None, "no id"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.fill_in_middle(docs, unit=unit, block=block)
    back = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *brute_fim(i, t, unit)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=str) == want
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}


def test_fim_of_odd_rows(messy, nothing):
    rows = fim.digest(fim.fill_in_middle(messy)).collect()
    want = sorted(((r.doc_id, hashlib.sha256(brute_fim(r.doc_id, r.text)[4].encode()).hexdigest(),
                    hashlib.sha256((r.text or "").encode()).hexdigest()) for r in messy.collect()), key=str)
    assert sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in rows), key=str) == want
    assert fim.fill_in_middle(nothing).count() == 0
    with pytest.raises(ValueError):
        fim.unit_starts(np.zeros(1, np.uint8), np.array([0, 1]), "line")
