import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logsift.llm import decontaminate, langid, quality, toxicity


def edit_inside(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=60), st.integers(0, 8))
def test_myers(pattern, text, k):
    got, want = decontaminate.myers(pattern, text, k), edit_inside(pattern, text)
    assert (got[0] if got else None) == (want if want <= k and text else None)


def test_items_equal_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdefgh "
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(i, say(rng.randrange(20, 120))) for i in range(12)] + [(90, "ab"), (91, ""), (92, None)]
    docs = []
    for i in range(120):
        _, item = items[rng.randrange(12)]
        chars = list(item)
        for _ in range(rng.randrange(9)):
            chars[rng.randrange(len(chars))] = rng.choice(letters)
        docs.append((i, say(rng.randrange(80)) + " " + "".join(chars).upper() + "!! " + say(30)))
    docs += [(500, None), (501, ""), (502, "ab"), (503, "cab")]
    want = set()
    for i, t in docs:
        text = decontaminate.normalise(t)
        for n, item in items:
            pattern = decontaminate.normalise(item)
            k = int(0.05 * (len(pattern) - 2))
            if t and pattern.strip() and (d := edit_inside(pattern.strip() if k else pattern, text)) <= k:
                want.add((i, n, d))
    args = (spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
            spark.createDataFrame(items, "item_id long, text string"))
    for block in (decontaminate.BLOCK_BYTES, 300):
        got = decontaminate.find_items(*args, block_bytes=block)
        assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want
    kept = decontaminate.keep_uncontaminated(*args)
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {w[0] for w in want}
    assert decontaminate.find_items(args[0], args[1].limit(0)).count() == 0


def test_statistics_are_finite(messy, nothing):
    stats = quality.features(messy)
    assert stats.count() == messy.count()
    model = quality.fit(stats, messy.select("doc_id", F.lit(None).cast("int").alias("y")))
    assert len({r.score for r in quality.score(stats, model).collect()}) == 1  # nothing to learn from
    assert quality.keep_good(nothing, model).count() == 0
    assert quality.score(quality.features(nothing), model).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(700):
        words = [rng.choice(vocab) for _ in range(rng.randrange(20, 80))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words]
        if rude:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grubble", "snorkin"]) + rng.choice(["", "s", "ed"])
        rows.append((i, " ".join(words), int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_held_out_quality(labelled):
    stats = quality.features(labelled)
    model = quality.fit(stats, labelled.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("y")))
    got = quality.score(stats, model).join(labelled, "doc_id").where("doc_id % 2 = 1").collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert sum((r.score >= 0.5) == bool(r.quality) for r in got) / len(got) > 0.97


def test_held_out_toxicity(labelled, messy, nothing):
    model = toxicity.fit(labelled, labelled.where("doc_id % 2 = 0").select("doc_id", F.col("toxic").alias("y")))
    got = toxicity.score(labelled, model).join(labelled, "doc_id").where("doc_id % 2 = 1").collect()
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in got) / len(got) > 0.95
    assert toxicity.score(messy, model).count() == messy.count()
    assert toxicity.keep_clean(messy, model).columns == messy.columns
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(nothing, labelled.select("doc_id", F.col("toxic").alias("y")))
    assert {r.score for r in toxicity.score(messy, blank).collect()} == {0.1}


def test_toxicity_cuts_follow_all_labels(labelled, monkeypatch):
    """However few rows the filters learn from, the cuts see every labelled row once."""
    counts, cut = [], toxicity._best_cut

    def noted(rows, hits, *rest):
        counts.append((rows.sum(), hits.sum()))
        return cut(rows, hits, *rest)

    monkeypatch.setattr(toxicity, "_best_cut", noted)
    labels = labelled.select("doc_id", F.col("toxic").alias("y"))
    toxicity.fit(labelled, labels, sample_rows=60)
    want = (labels.count(), labels.where("y = 1").count())
    assert counts[0] == want and tuple(map(sum, zip(*counts[1:]))) == want


def test_toxicity_learns_from_labels_that_have_documents(spark, labelled):
    beyond = spark.range(10_000, 60_000).selectExpr("id as doc_id", "cast(id % 2 as int) as y")
    labels = labelled.select("doc_id", F.col("toxic").alias("y")).unionAll(beyond)
    got = toxicity.score(labelled, toxicity.fit(labelled, labels, sample_rows=200)).join(labelled, "doc_id").collect()
    assert sum((r.score >= 0.3) == bool(r.toxic) for r in got) / len(got) > 0.95


def test_languages(spark):
    en, de = "the house of the old man was in the garden ", "der alte mann war in dem garten und das haus "
    docs = spark.createDataFrame([(en * 20, "en"), (de * 20, "de"), (None, "fr"), ("x", None)], "text string, lang string")
    page = "<html{}><script>{}</script><nav>nav</nav><p>{}</p></html>"
    rows = [(1, "http://a.example.com/x", page.format("", de * 5, en * 5)),
            (2, "http://a.example.de:80/en/", page.format(' lang="de"', "", de * 5)),
            (3, None, None), (4, "not a url", ""), (5, "https://b.example.de/", page.format(" lang='de-AT'", "", "")),
            (5, "https://b.example.de/", page.format(" lang='de-AT'", "", "")), (None, "http://[", "<p>")]
    pages = spark.createDataFrame([(*r, "zz") for r in rows], "page_id long, url string, html string, lang string")
    got = langid.identify(pages, docs).collect()
    assert len(got) == len(rows)
    lang = {r.page_id: r.lang for r in got}
    assert lang[1] == "en" and lang[2] == "de" and lang[5] == "de" and lang[3] in ("en", "de")
    assert all(0 < r.confidence <= 1 for r in got)
    assert langid.address("http://fr.site.example.org/de/x")[3] == "de"
    assert {r.lang for r in langid.identify(pages, docs.limit(0)).collect()} == {None}
    assert langid.identify(pages.limit(0), docs).count() == 0


def test_pipeline_stages_keep_columns(spark, messy):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert rows.select("doc_id").distinct().count() == docs.count()


def test_toxicity_gradients_equal_differences():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, toxicity.SLOTS, (n, 3)).astype(np.int32) for n in (7, 1, 12, 4)]
    ids, first = np.concatenate(words), np.cumsum([0, 7, 1, 12, 4])
    y, weight = np.array([0, 1, 1, 0]), np.array([0.6, 1.5, 1.5, 0.6])
    m = toxicity._start(rng.integers(0, 5, (2, 3, toxicity.SLOTS)), np.array([50, 20]))
    m.tables = [t.astype(float) for t in m.tables]
    _, at, back = toxicity._gradients(m, ids, first, y, weight)

    def loss():
        emb = sum(t[ids[:, j]] for j, t in enumerate(m.tables))
        total = 0.0
        for a, b, label, w in zip(first, first[1:], y, weight):
            top = [max([0.0] + [m.bias[i * toxicity.FILTERS + f] + sum(emb[p + j] @ k[j, :, f] for j in range(len(k)) if p + j < b)
                                for p in range(a, b)]) for i, k in enumerate(m.kernels) for f in range(toxicity.FILTERS)]
            z = np.array(top) @ m.out + m.out_bias
            total += w * (np.log1p(np.exp(z)) - label * z) / len(y)
        return total

    assert len(at)
    for word in np.unique(at)[:6]:
        for d in range(3):
            row = m.tables[0][ids[word, 0]]
            same = ids[:, 0] == ids[word, 0]
            want = back[np.isin(at, np.flatnonzero(same)), d].sum()
            kept, row[d] = row[d], row[d] + 1e-6
            up, row[d] = loss(), kept - 1e-6
            slope, row[d] = (up - loss()) / 2e-6, kept
            assert slope == pytest.approx(want, abs=1e-6)


def test_toxicity_trains_its_embeddings(labelled):
    starts, start = [], toxicity._start
    try:
        toxicity._start = lambda *a: starts.append(start(*a)) or starts[-1]
        model = toxicity.fit(labelled, labelled.select("doc_id", F.col("toxic").alias("y")), sample_rows=100)
    finally:
        toxicity._start = start
    moved = [np.abs(a - b).max(1) > 0 for a, b in zip(model.tables, starts[0].tables)]
    assert all(0 < m.sum() < toxicity.SLOTS / 2 for m in moved)
