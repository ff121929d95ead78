import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsift.llm import divergence

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, min_docs=3, top=200):
    docs = [(l or "", s or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))))
            for l, s, t in rows]
    df, groups = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter))
    for l, s, c in docs:
        df[l].update(c.keys())
        groups[l][s].update(c)
    out = []
    for l, of in groups.items():
        kept = [t for t, k in df[l].items() if k >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in of.items()}
        q = share(sum(of.values(), Counter()))
        for s in of:
            pairs = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in of if o != s}
            terms = {t: (p[s][t] - q[t]) ** 2 // q[t] for t in kept if of[s][t] > 0 and p[s][t] > q[t]}
            for part, items, cap in (("pair", pairs, None), ("term", terms, top)):
                best = sorted(items.items(), key=lambda x: (-x[1], x[0].encode()))[:cap]
                out += [(l, s, part, item, v, i) for i, (item, v) in enumerate(best, 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    words = [f"{a}{b}" for a in ("Al", "é", "zo", "日") for b in ("x", "Yé", "tt", "q'r", "")]
    rows = []
    for i in range(250):
        lang = [None, "en", "fr", "de\0x"][int(rng.integers(0, 4))]
        src = [None, "", "s1", "s2", "s3", "tail"][int(rng.integers(0, 6))]
        rows.append((lang, src, " ".join(rng.choice(words, int(rng.integers(0, 12)), p=None)) if rng.random() > 0.1 else None))
    rows += [("en", "silent", "123 --"), ("xx", "only", "few words"), ("xx", "other", None), ("yy", "alone", "b b b")]
    rows += [("en", "s1", "hot Hot hot")] * 90  # a third of all rows are one text
    return spark.createDataFrame(rows, "lang string, source string, text string"), rows


@pytest.mark.parametrize("kw", [{}, {"min_docs": 1, "top": 3}])
def test_against_brute_force(corpus, kw):
    df, rows = corpus
    assert got(df, **kw) == brute(rows, kw.get("min_docs", 3), kw.get("top", 200))


def test_blocks_and_slices_of_the_pairs(corpus, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_AT_ONCE", 2)
    monkeypatch.setattr(divergence, "ENTRIES_AT_ONCE", 7)
    assert got(corpus[0]) == brute(corpus[1])


def test_odd_rows(messy, nothing):
    rows = [(r.lang, r.source, r.text) for r in messy.collect()]
    assert got(messy, min_docs=1) == brute(rows, 1)
    assert got(messy) == brute(rows)
    assert divergence.audit(nothing).count() == 0
    assert got(messy.withColumn("lang", F.lit(None).cast("string"))) == brute([(None, s, t) for _, s, t in rows])


def test_long_texts_are_counted_in_pieces():
    texts = pa.array(["ab Cd é " * 50, "x" * 300, None, "ab1ab " * 40 + "日本", "tail"])
    parts, whole = (
        sorted(zip(doc.tolist(), [w.decode() for w in words.take(pa.array(place)).to_pylist()], n.tolist()))
        for doc, place, n, words in (divergence.vectors(texts, k) for k in (16, 1 << 20)))
    assert parts == whole and (1, "x" * 300, 1) in whole and (3, "ab", 80) in whole


def test_very_large_counts_stay_exact(spark):
    rows = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_001)], "n long, w long")
    assert rows.select(divergence._share("n", "w")).first()[0] == 1 + 10**9 * 9_000_000_000_001 // 10_000_000_000_001
