"""Source divergence audit (operator 12): how far apart a language's sources are in words.

The method is CountVectorizer's, per language, without a cap on the vocabulary: documents
become exact sparse vectors of term counts, a language keeps the terms of at least so many
of its documents, vectors are summed by (lang, source) without being made dense, and pairs
of sources are evaluated on the terms that occur in either.

The class itself keeps its whole vocabulary on the driver and broadcasts it.  Here the
vocabulary is a table: each batch of documents is vectorised over the terms it has, batches
send sums by group and term, and what is kept is decided by grouping and joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, stage, text_bytes
from logsift.llm.mixing import prefix_sums
from logsift.llm.words import LOWER

BATCH_BYTES = 4 << 20
SOURCES_AT_ONCE = 256  # sources of a block of the pair evaluation, on either side
ENTRIES_AT_ONCE = 1 << 14  # (source, term) entries of such a block, about
SCALE = 1_000_000_000
_IN_TERM = np.ones(256, bool)
_IN_TERM[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


def _spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of the terms: maximal runs of letters and of all beyond ASCII."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IN_TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def _count(low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Sparse vectors of the texts: (text, place in the vocabulary, count) and the vocabulary."""
    start, end, doc = _spans(low, off)
    cuts = np.empty(2 * len(start) + 1, np.int64)  # terms and what lies between them
    cuts[:-1:2], cuts[1::2], cuts[-1] = start, end, len(low)
    every = pa.Array.from_buffers(pa.large_binary(), 2 * len(start), [None, pa.py_buffer(cuts), pa.py_buffer(low)])
    coded = every.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    size = max(len(coded.dictionary), 1)
    key, n = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
    return key // size, key % size, n, coded.dictionary


def vectors(texts: pa.Array, batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """``_count`` of whole texts; a very long one is counted in pieces that end outside of
    terms, and the pieces' counts are added up."""
    buf, off = text_bytes(texts)
    low = np.ascontiguousarray(LOWER[buf])
    if len(low) <= 2 * batch_bytes:
        return _count(low, off)
    parts, at = [], 0
    while at < len(low):
        to = at + batch_bytes
        gap = np.flatnonzero(~_IN_TERM[low[to:]][:batch_bytes]) if to < len(low) else []
        while to < len(low) and not len(gap):  # a term of that length
            to += batch_bytes
            gap = np.flatnonzero(~_IN_TERM[low[to:]][:batch_bytes])
        to = min(to + int(gap[0]), len(low)) if len(gap) else len(low)
        doc, place, n, words = _count(low[at:to], np.clip(off, at, to) - at)
        parts.append(pa.table({"doc": doc, "term": words.take(pa.array(place)), "n": n}))
        at = to
    whole = pa.concat_tables(parts).group_by(["doc", "term"]).aggregate([("n", "sum")]).combine_chunks()
    coded = whole["term"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return whole["doc"].to_numpy(), coded.indices.to_numpy(), whole["n_sum"].to_numpy(), coded.dictionary


def _blank(docs: DataFrame, col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit("")) if col in docs.columns else F.lit("")


def group_sums(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): a term's occurrences in a group and the group's
    documents that have it, summed over the documents' vectors in each batch, in each task
    and then over all."""
    rows = docs.select(_blank(docs, lang_col).alias("lang"), _blank(docs, source_col).alias("source"),
                       _blank(docs, text_col).alias("text"))

    def add(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            doc, place, n, words = vectors(part.column("text"))
            if not len(doc):
                continue
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            key = group[doc] * len(words) + place
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group, place = key[first] // len(words), key[first] % len(words)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group // len(source.dictionary))),
                 source.dictionary.take(pa.array(group % len(source.dictionary))),
                 words.take(pa.array(place)).cast(pa.binary()).cast(pa.string()),
                 pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, len(key))))],
                names=["lang", "source", "term", "n", "docs"])

    return (rows.mapInArrow(add, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(count: str, whole: str) -> Column:
    """1 + floor(SCALE * (count + 1) / whole), in whole numbers of any length."""
    return F.expr(f"1L + cast((cast({count} as decimal(19,0)) + 1) * {SCALE} as decimal(38,0)) div cast({whole} as decimal(19,0))")


def _far(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def _shared(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """(g, o, v): for ordered pairs of a language's groups, the part of f's sum that the
    terms in both add to what each has alone.

    Sources meet in blocks of SOURCES_AT_ONCE and terms in slices, so a task's group has a
    bounded number of entries; all pairs of a term's sources are looked at there and only
    sums leave it."""
    slices = F.greatest(F.lit(1), F.ceil(F.col("entries") / ENTRIES_AT_ONCE)).cast("int")
    block = F.floor(F.col("g") / SOURCES_AT_ONCE).cast("int")
    placed = groups.withColumn("block", block)
    per_lang = placed.groupBy("lang").agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.sum("kinds").alias("entries"))
    rows = (entries.join(placed.select("lang", "source", "g", "block", "zero"), ["lang", "source"]).join(per_lang, "lang")
            .withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int")))
    all_blocks = F.explode(F.sequence("lo", "hi"))
    left = rows.select("lang", "slice", F.col("block").alias("a"), all_blocks.alias("b"), F.lit(0).alias("side"), "term", "g", "p", "zero")
    right = rows.select("lang", "slice", all_blocks.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), "term", "g", "p", "zero")

    def evaluate(t: pa.Table) -> pa.Table:
        code = t.column("term").combine_chunks().dictionary_encode()
        code = (code.indices if isinstance(code, pa.DictionaryArray) else code.combine_chunks().indices).to_numpy()
        side, g, p, zero = (t.column(c).to_numpy() for c in ("side", "g", "p", "zero"))
        order = np.lexsort((code, side))
        code, side, g, p, zero = (x[order] for x in (code, side, g, p, zero))
        m = int(np.searchsorted(side, 1))
        ls, lrow = np.unique(g[:m], return_inverse=True)
        rs, rrow = np.unique(g[m:], return_inverse=True)
        lo, hi = (m + np.searchsorted(code[m:], code[:m], s) for s in ("left", "right"))
        met = np.cumsum(hi - lo)
        total = np.zeros(len(ls) * len(rs), np.int64)
        for a in range(0, int(met[-1]) if m else 0, 1 << 20):  # pairs looked at together
            k = np.arange(a, min(a + (1 << 20), int(met[-1])))
            x = np.searchsorted(met, k, "right")
            y = hi[x] - (met[x] - k)
            far = lambda u, v: (u - v) * (u - v) // v
            v = far(p[x], p[y]) - far(p[x], zero[y]) - far(zero[x], p[y]) + far(zero[x], zero[y])
            np.add.at(total, lrow[x] * len(rs) + rrow[y - m], v)
        at = np.flatnonzero(total)
        return pa.table({"g": ls[at // max(len(rs), 1)], "o": rs[at % max(len(rs), 1)], "v": total[at]},
                        schema=pa.schema([("g", pa.int64()), ("o", pa.int64()), ("v", pa.int64())]))

    return left.unionAll(right).groupBy("lang", "slice", "a", "b").applyInArrow(evaluate, "g long, o long, v long")


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the
    language by its distance, part ``term`` the ``top`` terms that a source has more of than
    its language.

    Terms are runs of letters (all beyond ASCII counts as one), A-Z lower-cased; a language
    keeps the V terms of at least ``min_docs`` of its documents.  A group's share of a term
    is p = 1 + floor(1e9 * (count + 1) / (N + V)), the distance of p from q is
    floor((p - q)^2 / q), and a pair's is the sum over all kept terms: those that neither or
    only one of the two has come from counts of counts, those of both from ``_shared``.

    Null text, lang and source count as empty; an empty or wordless text adds a document
    without terms, so its group has pairs and no terms; ties go by the item's bytes;
    repeated rows count each time, also towards ``min_docs``; very long texts are read
    whole, one at a time; an empty table gives no rows.  Other columns are not read."""
    sums = stage(group_sums(docs, lang_col, source_col, text_col), "sums")
    kept = (sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("term_n"))
            .where(F.col("docs") >= min_docs).drop("docs"))
    counts = stage(sums.drop("docs").join(kept, ["lang", "term"]), "counts")  # of kept terms
    vocabulary = counts.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(
        counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang")
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    groups = (docs.select(_blank(docs, lang_col).alias("lang"), _blank(docs, source_col).alias("source")).distinct()
              .join(own, ["lang", "source"], "left").join(vocabulary, "lang", "left")
              .select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("kinds", F.lit(0)).alias("kinds"),
                      F.greatest(F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0)), F.lit(1)).alias("whole"),
                      F.greatest(F.coalesce("lang_n", F.lit(0)) + F.coalesce("v", F.lit(0)), F.lit(1)).alias("lang_whole"))
              .withColumn("zero", _share("0", "whole")).withColumn("one", F.lit(1).cast("long")))
    groups = stage(prefix_sums(groups, ["lang", "source"], {"g": "one"}, "groups").drop("one"), "placed")
    entries = stage(counts.join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
                    .withColumn("p", _share("n", "whole")), "entries")

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (entries.withColumn("q", _share("term_n", "lang_whole")).where("p > q")
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _far("p", "q").alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    # n terms of a group that occur c times there; c = 0: the kept terms it lacks
    times = entries.groupBy("lang", "source", F.col("n").alias("c"), "p").agg(F.count(F.lit(1)).alias("times"))
    lacking = groups.select("lang", "source", F.lit(0).cast("long").alias("c"), F.col("zero").alias("p"),
                            (F.col("v") - F.col("kinds")).alias("times"))
    here = (times.unionByName(lacking).join(groups.select("lang", "source", "g", "zero"), ["lang", "source"])
            .select("lang", "g", "c", "p", "times", "zero"))
    there = groups.select("lang", F.col("g").alias("o"), F.col("zero").alias("other"))
    met = here.join(there, "lang").where("g <> o")  # a row for each count a group has, and other source
    first = met.select("g", "o", (F.col("times") * _far("p", "other")).alias("v"))
    second = met.where("c > 0").select(F.col("o").alias("g"), F.col("g").alias("o"),
                                       (F.col("times") * (_far("other", "p") - _far("other", "zero"))).alias("v"))
    both = _shared(groups, entries.select("lang", "source", "term", "p")).where("g <> o")
    far = first.unionAll(second).unionAll(both).groupBy("g", "o").agg(F.sum("v").alias("value"))
    name = groups.select("g", "lang", "source")
    pairs = (far.join(name, "g").join(groups.select(F.col("g").alias("o"), F.col("source").alias("item")), "o")
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(terms)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(tot.n, 0) + langs.v) AS p,
         1 + (1000000000 * (k.n + 1)) // (langs.n + langs.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN tot ON tot.lang = g.lang AND tot.source = g.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value
  FROM grp g JOIN grp o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
