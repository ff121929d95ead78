import pathlib
import random
import time

import numpy as np
import pytest

from logsift.llm import covertree, neardup
from logsift.llm.components import components


def closure(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    want = closure({n for a, b in edges if a != b for n in (a, b)}, [e for e in edges if e[0] != e[1]])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def variants(n_groups=6, copies=25, words=60, edits=4):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    docs, i = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocab) for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(words)] = rng.choice(vocab)
            docs.append((i, " ".join(w)))
            i += 1
    shared = [rng.choice(vocab) for _ in range(40)]  # a passage that unlike documents share
    for _ in range(60):
        docs.append((i, " ".join(shared + [rng.choice(vocab) for _ in range(25)])))
        i += 1
    return docs


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = variants()
    s = {i: sets(t) for i, t in docs}
    links = [(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = closure(s, links)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.n_shingles == len(s[r.doc_id]) and r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_near_duplicates_of_odd_rows(messy, nothing):
    got = neardup.near_duplicates(messy).collect()
    assert len(got) == messy.count()
    by = {r.doc_id: (r.component_id, r.kept) for r in got}
    assert by[2] == (1, False) and by[6] == (5, False) and by[3] == (3, True) and by[8] == (8, True)
    assert by[None] == (None, True)
    kept = neardup.keep_one(messy)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10]
    assert neardup.near_duplicates(nothing).count() == 0


def test_one_row_of_each_group_stays(spark):
    same, other = "one text that is held more than once by the table", "quite another passage under the very same id as that"
    rows = [(1, same, "a")] * 3 + [(2, same, "b"), (3, same, "c"), (3, other, "d"), (4, "", "e"), (4, "", "f")]
    rows += [(6, "six rows of one id that are all equal here", "g")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.source) for r in kept.collect()) == [(1, "a"), (3, "d"), (4, "e"), (4, "f"), (6, "g")]
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert sorted(r.component_id for r in got if r.kept) == [1, 1, 1, 3, 4, 4] + [6] * 6


def vectors():
    rng = np.random.default_rng(8)
    rows, i = [], 0
    for _ in range(5):
        base = rng.normal(size=16)
        for _ in range(30):
            rows.append((i, (base + rng.normal(size=16) * rng.choice([0.02, 0.15, 0.25])).tolist()))
            i += 1
    rows += [(i + k, rng.normal(size=16).tolist()) for k in range(80)]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, [0.0] * 16), (903, None), (904, []),
             (905, [float("nan")] * 16), (906, [1.0, None] * 8), (907, [1.0, 2.0]), (None, rows[0][1]),
             (908, [float("inf")] + [1.0] * 15), (909, [1e-300] * 16), (910, [1e300] * 16)]
    return rows


@pytest.mark.parametrize("block", [covertree.BLOCK, 20])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, label int, far double")
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = x / np.linalg.norm(x)
    near = {i: [j for j in good if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95] for i in good}
    want = closure(good, [(i, j) for i, js in near.items() for j in js])
    got = covertree.near_vectors(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert r.component_id is None and r.kept and r.n_links == 0
        else:
            assert (r.n_links, r.component_id) == (len(near.get(r.vec_id, [])), want.get(r.vec_id, r.vec_id))
            assert r.kept == (r.component_id == r.vec_id)
    assert covertree.near_vectors(df.limit(0)).count() == 0


def grouped_vectors(n: int, seed: int) -> np.ndarray:
    """Single floats in 64 dimensions: most without structure, groups around the threshold,
    a tight group whose bounds link it as a whole, and repeats."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for k, noise in enumerate([0.01, 0.2, 0.22, 0.24, 0.3]):
        x[k * n // 10:(k + 1) * n // 10] = rng.normal(size=64) + rng.normal(size=(len(x[k * n // 10:(k + 1) * n // 10]), 64)) * noise
    x[-20:] = x[:20]
    return x[rng.permutation(n)].astype(np.float32)


def brute_force(x: np.ndarray) -> tuple[list[int], dict[int, int]]:
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    return near.sum(1).tolist(), closure(range(len(x)), np.argwhere(near).tolist())


@pytest.mark.parametrize("small", [False, True])
def test_blocks_meet_as_in_brute_force(monkeypatch, small):
    if small:
        monkeypatch.setattr(covertree, "TILE", 1 << 12)
        monkeypatch.setattr(covertree, "LEAF", 8)
    x = grouped_vectors(1500, 3)
    weights = np.random.default_rng(1).integers(1, 4, len(x))
    blocks = []
    for k, at in enumerate(np.array_split(np.arange(len(x)), [500, 700, 1100])):
        tree = covertree.Tree(covertree._unit(x[at]), 0.08)
        at = at[tree.order]
        blocks.append(covertree.Block({"dim": 64, "place": k, "ids": at.tobytes(), "ms": weights[at].tobytes(),
                                       "vecs": x[at].tobytes(), "tree": covertree.pickle.dumps(tree.levels)}))
    links = covertree.Links(0.95, blocks[:3])
    for i, b in enumerate(blocks):
        links.meet_home(b, i if i < 3 else 0)
    links.meet(blocks[3], blocks[3])
    got = {int(i): int(n) for b in blocks for i, n in zip(b.ids, b.n)}
    unit = covertree._unit(x)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    assert got == dict(enumerate((near @ weights).tolist()))
    assert closure(range(len(x)), zip(*(c.tolist() for c in links.found()))) == brute_force(x)[1]


def shuffled(spark) -> int:
    """Bytes of the shuffle files on disk."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(p.stat().st_size for d in dirs for p in pathlib.Path(d.getPath()).rglob("shuffle_*.data"))


def test_near_vectors_disk_stays_in_proportion(spark, monkeypatch):
    """However many pairs of blocks stay open, they are not on disk at once."""
    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "HOME_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(covertree, "ROUND_BYTES", 1 << 18, raising=False)
    x = grouped_vectors(1500, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    before, seen, write = shuffled(spark), [], covertree.stage

    def staged(*args):
        out = write(*args)
        time.sleep(0.2)  # files go in the background
        seen.append(shuffled(spark))
        return out

    monkeypatch.setattr(covertree, "stage", staged)
    got = {r.vec_id: r for r in covertree.near_vectors(df).collect()}
    assert max(seen) - before < 4 * x.nbytes
    counts, least = brute_force(x)
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(counts[i], least[i]) for i in range(len(x))]
