"""Language identification of web pages (operator 6): Bayesian evidence fusion.

The likelihood of the visible text (byte trigrams, counted over all labelled documents)
is combined with the language that the markup declares, the one that the address names
(path, subdomain, country suffix) and a prior of the host, smoothed towards its site, its
suffix and all pages.  How far markup and address can be trusted is itself counted."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, merged, stage, text_bytes
from logsift.llm.words import segment_reduce

BATCH_BYTES = 1 << 20
SLOTS = 1 << 13  # hashed trigrams
TEXT_WEIGHT = 40  # trigrams that a text counts for at most: they aren't independent
SMOOTH = 5.0  # pages that a wider level's shares count for in a narrower one
# Languages of country suffixes, chosen here.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en",
            "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "jp": "ja", "cn": "zh"}
_GONE = re.compile(r"<(script|style|noscript|template|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)
_META = re.compile(r"<meta\b[^>]*content-language[^>]*content\s*=\s*[\"']?([a-zA-Z]{2,3})\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(?:/([a-zA-Z]{2})(?=[/?#]|$))?", re.I)
_LETTERS = np.full(256, 32, np.uint8)  # letters in lower case, all else blank
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams, offsets) of each text; none that holds two blanks in a row."""
    b = _LETTERS[buf].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    code = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(19)
    ok = ~((b[:-2] == 32) & (b[1:-1] == 32) | (b[1:-1] == 32) & (b[2:] == 32))
    ends = off[1:]
    for back in (1, 2):  # trigrams must not run over a text's end
        at = ends - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    at = np.flatnonzero(ok)
    return code[at].astype(np.int64), np.searchsorted(at, off)


def visible(page: str) -> str:
    return html.unescape(_GONE.sub(" ", page))


def address(url: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(host, site: its last two labels, suffix, language that the address names)."""
    m = _HOST.match(url or "")
    if not m:
        return None, None, None, None
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    named = (m[2] or "").lower() or (labels[0] if len(labels) > 2 and len(labels[0]) == 2 else "") \
        or SUFFIXES.get(labels[-1], "")
    return host, ".".join(labels[-2:]), labels[-1], named or None


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each hashed trigram in each), counted over the whole
    texts of all documents with a language."""
    rows = documents.select(F.col(text_col).cast("string").alias("text"), F.lower(F.trim(F.col(lang_col))).alias("lang")) \
        .where("lang is not null and lang <> '' and text is not null")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for part in by_bytes(batches, "text", BATCH_BYTES):
            code, off = trigrams(*text_bytes(part.column("text")))
            langs = part.column("lang").to_pylist()
            names = sorted(set(langs))
            at = np.repeat(np.array([names.index(x) for x in langs]), np.diff(off))
            got = np.bincount(at * SLOTS + code, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
            for name, row in zip(names, got):
                total[name] = total.get(name, 0) + row
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()])],
                                             names=["lang", "counts"])

    def fold(t: pa.Table) -> dict[str, pa.Array]:
        total = sum(np.frombuffer(c, np.int64) for c in t.column("counts").to_pylist())
        return {"counts": pa.array([total.tobytes()], pa.binary())}

    got: dict[str, np.ndarray] = {}
    for r in merged(rows.mapInArrow(count, "lang string, counts binary"), fold, ("lang",)).collect():
        got[r["lang"]] = got.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    names = sorted(got)
    table = np.array([got[n] for n in names], float).reshape(len(names), SLOTS) + 0.5
    return names, np.log(table / table.sum(1, keepdims=True))


def evidence(pages: DataFrame, names: list[str], logp: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: host, site, suffix, declared, named (its address), ll and share (log
    likelihood and posterior of the text, an entry per language)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    sent = spark.sparkContext.broadcast(logp)  # languages x SLOTS numbers

    def run(batches):
        table = sent.value
        for part in by_bytes(batches, "html", BATCH_BYTES):
            raw = [h or "" for h in part.column("html").to_pylist()]
            code, off = trigrams(*text_bytes(pa.array([visible(h) for h in raw], pa.large_string())))
            sums = np.stack([segment_reduce(np.add, row[code], off, 0.0) for row in table], 1)
            n = np.maximum(np.diff(off), 1)[:, None]
            ll = sums / n * np.minimum(n, TEXT_WEIGHT)
            share = np.exp(ll - ll.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            said = [m[1].lower() if (m := _DECLARED.search(h) or _META.search(h)) else None for h in raw]
            where = [address(u) for u in part.column("url").to_pylist()]
            strings = [pa.array([w[i] for w in where], pa.string()) for i in range(3)]
            lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (ll, share)]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), *strings, pa.array(said, pa.string()),
                 pa.array([w[3] for w in where], pa.string()), *lists],
                names=["page_id", "host", "site", "suffix", "declared", "named", "ll", "share"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, site string, "
                                "suffix string, declared string, named string, ll array<double>, share array<double>")


def _trust(pages: DataFrame, col: str, names: list[str]) -> Column:
    """Log likelihood of the value of ``col`` under each language, for the languages,
    'other' and no value, from the pages' soft counts."""
    value = F.when(F.col(col).isin(names), F.col(col)).when(F.col(col).isNull(), "none").otherwise("other")
    sums = pages.groupBy(value.alias("v")).agg(*[F.sum(F.get("share", F.lit(i))).alias(f"s{i}") for i in range(len(names))])
    got = {r["v"]: [r[f"s{i}"] for i in range(len(names))] for r in sums.collect()}  # len(names) + 2 rows
    seen = np.array([got.get(v, [0.0] * len(names)) for v in [*names, "other", "none"]])
    # half a page for each value; five that agree
    seen = seen + 0.5 + 4.5 * np.eye(len(names) + 2, len(names))
    w = np.log(seen / seen.sum(0))
    lookup = F.create_map(*[x for v, row in zip([*names, "other", "none"], w)
                            for x in (F.lit(v), F.array(*[F.lit(float(p)) for p in row]))])
    return F.element_at(lookup, value)


def identify(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", url_col: str = "url",
             html_col: str = "html") -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, named, host of every page.

    ``lang`` has the largest posterior, ties go to the first name; ``text_lang`` is what the
    text alone says.  A null or empty page counts by its address and host; a null or odd url
    has no host and takes the shares of all pages; a page's own text is left out of its
    host's shares.  Repeated rows each get a row; without any labelled document lang is null.
    Other columns are not read.  Host shares are partial sums; hosts of very many pages are
    split by the skew join."""
    names, logp = fit(documents)
    if not names:
        kind = pages.select(id_col).schema[0].dataType.simpleString()
        return pages.select(F.col(id_col).cast(kind).alias("page_id"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("lang", "string"), ("confidence", "double"), ("text_lang", "string"), ("declared", "string"),
            ("named", "string"), ("host", "string"))])
    seen = stage(evidence(pages, names, logp, id_col, url_col, html_col), "page-evidence")
    n, each = len(names), range(len(names))
    sums = lambda d, *by: d.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in each])
    flat = seen.select("host", "site", "suffix", *[F.get("share", F.lit(i)).alias(f"s{i}") for i in each])
    hosts = stage(sums(flat.where("host is not null"), "host", "site", "suffix"), "hosts")
    everything = flat.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in each]).first()
    total = sum(everything) or 1.0
    shares = F.array(*[F.lit((s + 1.0 / n) / (total + 1.0)) for s in everything])

    def smoothed(own, wider):
        """Shares of a level from its sums, drawn to the wider level's."""
        size = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
        return F.zip_with(own, wider, lambda v, w: (v + SMOOTH * w) / (size + SMOOTH))

    vector = F.array(*[F.col(f"s{i}") for i in each])
    suffixes = sums(hosts, "suffix").select("suffix", smoothed(vector, shares).alias("p_suffix"))
    sites = sums(hosts, "site", "suffix").join(suffixes, "suffix").select(
        "site", "suffix", smoothed(vector, F.col("p_suffix")).alias("p_site"))
    levels = hosts.join(sites, ["site", "suffix"]).select("host", vector.alias("host_sums"), "p_site")
    own = F.zip_with("host_sums", "share", lambda v, s: F.greatest(v - s, F.lit(0.0)))
    prior = F.when(F.col("p_site").isNotNull(), smoothed(own, F.col("p_site"))).otherwise(shares)
    score = F.zip_with(F.zip_with(F.col("ll"), F.transform(prior, lambda p: F.log(p)), lambda a, b: a + b),
                       F.zip_with(_trust(seen, "declared", names), _trust(seen, "named", names), lambda a, b: a + b),
                       lambda a, b: a + b)
    langs = F.array(*[F.lit(x) for x in names])
    best = lambda c: F.get(langs, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return (seen.join(levels, "host", "left").withColumn("score", score)
            .select("page_id", best("score").alias("lang"),
                    (1 / F.aggregate("score", F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max("score")))).alias("confidence"),
                    best("share").alias("text_lang"), "declared", "named", "host"))
