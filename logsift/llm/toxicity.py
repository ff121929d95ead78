"""Toxicity (operator 10): a convolutional text classifier trained in numpy on Spark's tasks.

Words are hashed to embeddings that are trained with the filters (whole word, and two
prefixes, so that unseen forms of a stem are known), filters of widths 1 to 3 slide over them, each filter's maximum over
the text goes to a logistic output, and the cut is calibrated for each language as told
from the text's own function words."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, stage, text_bytes
from logsift.llm.words import LOWER, segment_reduce, word_hashes, word_spans

BATCH_BYTES = 1 << 20
SLOTS = 1 << 15  # rows of each embedding table
PREFIXES = (5, 7)  # bytes
EMBED, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
SAMPLE_ROWS = 3000  # labelled rows of each class that the filters learn from, about
EMBED_RATE = 0.5  # step of the embedding rows, plain descent
SHARDS, STEP_ROWS = 8, 16  # the sample's parts, the same on any cluster, and rows of a step
BUCKETS = 1 << 14  # of hashed ids, to find the sample's bound
BINS, REACH = 2000, 14.0  # of the log odds from -REACH to REACH, for the cuts
# Frequent function words by language, chosen here.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are with as be at by this from or",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
LANGS = ("other", *FUNCTION_WORDS)
_TO_SPACE = LOWER.copy()  # lower case; ASCII signs part words
_TO_SPACE[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def _function_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words and how much each speaks for each language."""
    said: dict[str, list[int]] = {}
    for i, words in enumerate(FUNCTION_WORDS.values(), 1):
        for w in words.split():
            said.setdefault(w, []).append(i)
    buf, off = _encode(list(said))
    h = word_hashes(buf, off[:-1], off[1:])
    weight = np.zeros((len(h), len(LANGS)))
    for row, of in enumerate(said.values()):
        weight[row, of] = 1 / len(of)
    order = np.argsort(h)
    return h[order], weight[order]


_FUNCTION = _function_hashes()


def word_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of every word in the embedding tables, first word of each text, language of
    each text: index into LANGS)."""
    buf = _TO_SPACE[buf]
    s, e, first = word_spans(buf, off)
    h = word_hashes(buf, s, e)
    slots = np.uint64(SLOTS)
    ids = [h % slots] + [word_hashes(buf, s, np.minimum(e, s + p)) % slots for p in PREFIXES]
    known, weight = _FUNCTION
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    votes = np.where((known[at] == h)[:, None], weight[at], 0)
    share = segment_reduce(np.add, votes, first, 0.0)
    share[:, 0] = np.diff(first) * 0.02  # fewer function words than that: another language
    return np.stack(ids, 1).astype(np.int32), first, share.argmax(1)


@dataclass
class Model:
    tables: list[np.ndarray] = field(default_factory=list)  # one per kind of hash: SLOTS x EMBED
    kernels: list[np.ndarray] = field(default_factory=list)  # one per width: width x EMBED x FILTERS
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: float = 0.0
    cuts: np.ndarray | None = None  # probability that counts as the cut, by language
    threshold: float = 0.3
    _ready: list = field(default_factory=list, repr=False)

    def responses(self) -> list[np.ndarray]:
        """What each embedding row adds to each filter at each of its positions."""
        if not self._ready:
            kernel = np.concatenate([k for w in self.kernels for k in w], 1)
            self._ready = [np.ascontiguousarray(t @ kernel, np.float32) for t in self.tables]
        return self._ready

    def __getstate__(self):
        return self.__dict__ | {"_ready": []}

    def pooled(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each text, and the word where it begins."""
        n, words = len(first) - 1, len(ids)
        add = sum(t[ids[:, j]] for j, t in enumerate(self.responses()))
        top = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        col = 0
        room = np.repeat(first[1:], np.diff(first)) - np.arange(words)
        for i, width in enumerate(WIDTHS):
            out = np.zeros((words, FILTERS), np.float32)
            for j in range(width):
                out[:words - j] += np.where((room > j)[:words - j, None], add[j:, col:col + FILTERS], 0)
                col += FILTERS
            out += self.bias[i * FILTERS:(i + 1) * FILTERS]
            top[:, i * FILTERS:(i + 1) * FILTERS] = segment_reduce(np.maximum, out, first, np.float32(0))
        return np.maximum(top, 0), top

    def probability(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.pooled(ids, first)[0] @ self.out + self.out_bias, -30, 30)))

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability moved so that the language's cut lies at ``threshold``."""
        if self.out is None:
            return np.full(len(off) - 1, 0.1)
        ids, first, lang = word_ids(buf, off)
        p = np.clip(self.probability(ids, first), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(_logit(p) - _logit(self.cuts[lang]) + _logit(self.threshold))))


def _seen(ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Texts that hold each slot: label x kind of hash x SLOTS."""
    doc = np.repeat(np.arange(len(y)), np.diff(first))
    out = np.zeros((2, 1 + len(PREFIXES), SLOTS), np.int32)
    for kind in range(1 + len(PREFIXES)):
        seen = np.unique(doc.astype(np.int64) * SLOTS + ids[:, kind])
        for v in (0, 1):
            out[v, kind] = np.bincount(seen[y[seen // SLOTS] == v] % SLOTS, minlength=SLOTS)
    return out


def _odds(neg: np.ndarray, pos: np.ndarray, rate: float) -> np.ndarray:
    """How surely a slot's presence speaks for the label: log odds over their error."""
    prior = 2.0
    a, b = pos + prior * rate, neg + prior * (1 - rate)
    z = (np.log(a / b) - np.log(rate / (1 - rate))) / np.sqrt(1 / a + 1 / b)
    return np.clip(z, -4, 8)


def _start(seen: np.ndarray, n: np.ndarray) -> Model:
    """The first embedding numbers are each slot's odds in the sample and the first filters
    read them; the rest starts at random.  ``n``: texts of each label."""
    rng = np.random.default_rng(3)
    m = Model(tables=[rng.normal(0, 0.05, (SLOTS, EMBED)).astype(np.float32) for _ in range(1 + len(PREFIXES))],
              kernels=[rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS],
              bias=np.zeros(FILTERS * len(WIDTHS), np.float32))
    for j, t in enumerate(m.tables):
        t[:, j] = _odds(seen[0, j], seen[1, j], max(n[1] / n.sum(), 1e-3)) / 4
    for k in m.kernels:
        k[:, :3, :3] = np.eye(3) / len(k)
        k[:, :3, 3] = 0.5 / len(k)
    m.out = rng.normal(0.2, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    return m


def _parameters(m: Model) -> np.ndarray:
    """What is learned beside the embeddings, as one vector."""
    return np.concatenate([m.out, m.bias, *[k.ravel() for k in m.kernels], [m.out_bias]]).astype(float)


def _with(m: Model, v: np.ndarray) -> Model:
    ends = np.cumsum([len(m.out), len(m.bias), *[k.size for k in m.kernels]])
    out, bias, *kernels, last = np.split(v, ends)
    return replace(m, out=out.astype(np.float32), bias=bias.astype(np.float32), out_bias=float(last[0]), _ready=[],
                   kernels=[k.reshape(o.shape).astype(np.float32) for k, o in zip(kernels, m.kernels)])


def _batches(part: pa.RecordBatch):
    """(shard, half, y, ids, first) of each run of one shard's rows."""
    shard = part.column("shard").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:]):
        rows = part.slice(a, b - a)
        raw = rows.column("ids").to_pylist()
        first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]) // (4 * (1 + len(PREFIXES)))
        ids = np.frombuffer(b"".join(raw), np.int32).reshape(-1, 1 + len(PREFIXES))
        yield int(shard[a]), rows.column("half").to_numpy(), rows.column("y").to_numpy(), ids, first


def _pick(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = [np.arange(first[r], first[r + 1]) for r in rows]
    return ids[np.concatenate(words)], np.concatenate([[0], np.cumsum([len(w) for w in words])])


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(half x label: texts, half x label x kind x SLOTS: texts that hold the slot); one row
    of fixed size from each task."""
    def run(batches):
        n, seen = np.zeros((2, 2), np.int64), np.zeros((2, 2, 1 + len(PREFIXES), SLOTS), np.int32)
        for part in by_bytes(batches, "ids", BATCH_BYTES):
            for _, half, y, ids, first in _batches(part):
                for h in (0, 1):
                    at = np.flatnonzero(half == h)
                    if len(at):
                        n[h] += np.bincount(y[at], minlength=2)
                        seen[h] += _seen(*_pick(ids, first, at), y[at])
        if n.sum():
            yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())],
                                             names=["n", "seen"])

    n, seen = np.zeros((2, 2), np.int64), np.zeros((2, 2, 1 + len(PREFIXES), SLOTS), np.int32)
    for r in rows.mapInArrow(run, "n binary, seen binary").toLocalIterator():  # one task's sums at a time
        n += np.frombuffer(r["n"], np.int64).reshape(n.shape)
        seen += np.frombuffer(r["seen"], np.int32).reshape(seen.shape)
    return n, seen


def train(rows: DataFrame, models: list[tuple[Model, tuple, float]], epochs: int = 8, rate: float = 0.01) -> list[Model]:
    """Logistic loss, in rounds: every shard of ``rows`` takes its texts in small steps from the
    same start, Adam for the filters and the output, plain descent for the embedding rows that
    a step's maxima touch.  The shards' parameters and moments, a few kB each, are averaged by
    their texts, an embedding row's moves by the texts of the shards that touched it; a shard
    sends touched rows only, all rows of the tables (3.5 MB) at most.  ``models``: (start,
    halves it learns from, share of label 1)."""
    context = rows.sparkSession.sparkContext
    on, share = [halves for _, halves, _ in models], [r for _, _, r in models]
    weights = [np.array([0.5 / max(1 - r, 1e-3), 0.5 / max(r, 1e-3)]) for r in share]
    now = [m for m, _, _ in models]
    size = len(_parameters(now[0]))
    state = [np.concatenate([_parameters(m), np.zeros(2 * size)]) for m in now]  # parameters, two moments
    step = [0] * len(models)
    for _ in range(epochs):
        sent, start, since = context.broadcast(now), state, list(step)

        def run(batches):
            held: dict[tuple, _Shard] = {}
            for part in by_bytes(batches, "ids", BATCH_BYTES):
                for shard, half, y, ids, first in _batches(part):
                    for i, m in enumerate(sent.value):
                        if (shard, i) not in held:
                            held[shard, i] = _Shard(m, start[i], since[i])
                        at = np.flatnonzero(np.isin(half, on[i]) & (np.diff(first) > 0))
                        for b in np.array_split(at, -(-len(at) // STEP_ROWS)) if len(at) else []:
                            held[shard, i].step(*_pick(ids, first, b), y[b], weights[i][y[b]], rate)
            got = [(i, *h.result()) for (_, i), h in sorted(held.items(), key=lambda x: x[0]) if h.n]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (
                    pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=names)

        names = ["model", "steps", "n", "state", "touched", "moves"]
        moved = rows.mapInArrow(run, "model int, steps long, n long, state binary, touched binary, moves binary").collect()
        state = list(state)
        for i, m in enumerate(now):
            mine = sorted((r for r in moved if r["model"] == i), key=lambda r: r["state"])  # one row per shard
            if mine:
                n = sum(r["n"] for r in mine)
                state[i] = sum(np.frombuffer(r["state"]) * (r["n"] / n) for r in mine)
                step[i] += max(r["steps"] for r in mine)
                now[i] = replace(_with(m, state[i][:size]), tables=_moved(m.tables, mine))
        sent.unpersist()
    return now


def _moved(tables: list[np.ndarray], shards: list) -> list[np.ndarray]:
    """The tables after the shards' moves."""
    total, texts = np.zeros((len(tables) * SLOTS, EMBED)), np.zeros(len(tables) * SLOTS)
    for r in shards:
        at = np.frombuffer(r["touched"], np.int32)  # each row once
        total[at] += r["n"] * np.frombuffer(r["moves"], np.float32).reshape(-1, EMBED)
        texts[at] += r["n"]
    total /= np.maximum(texts, 1)[:, None]
    return [t + move.astype(np.float32) for t, move in zip(tables, np.split(total, len(tables)))]


class _Shard:
    """One model as one shard moves it within a round."""

    def __init__(self, m: Model, state: np.ndarray, steps: int):
        self.start, self.tables = m.tables, [t.copy() for t in m.tables]
        self.model = replace(m, tables=self.tables, _ready=[])
        self.touched = np.zeros((len(self.tables), SLOTS), bool)
        self.state, self.since, self.steps, self.n = state.copy(), steps, 0, 0

    def step(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        v = self.state.reshape(3, -1)
        g, at, back = _gradients(_with(self.model, v[0]), ids, first, y, weight)
        self.steps += 1
        self.n += len(y)
        t = self.since + self.steps
        v[1] = 0.9 * v[1] + 0.1 * g
        v[2] = 0.999 * v[2] + 0.001 * g * g
        v[0] -= rate * (v[1] / (1 - 0.9 ** t)) / (np.sqrt(v[2] / (1 - 0.999 ** t)) + 1e-8)
        for j, table in enumerate(self.tables):  # a word's embedding is the sum of its rows
            row = ids[at, j].astype(np.int64)
            np.subtract.at(table.reshape(-1), (row[:, None] * EMBED + np.arange(EMBED)).ravel(),
                           (EMBED_RATE * back).astype(np.float32).ravel())
            self.touched[j, row] = True

    def result(self) -> tuple[int, int, bytes, bytes, bytes]:
        """Steps, texts, state, touched rows of all tables, their moves."""
        at = np.flatnonzero(self.touched).astype(np.int32)
        moves = np.concatenate(self.tables)[at] - np.concatenate(self.start)[at]
        return self.steps, self.n, self.state.tobytes(), at.tobytes(), moves.astype(np.float32).tobytes()


def _gradients(m: Model, ids: np.ndarray, first: np.ndarray, y: np.ndarray,
               weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient in the order of _parameters, words, gradient of each such word's embedding).
    Only the words at which a filter has its maximum receive a gradient; a word may be
    listed more than once."""
    emb = sum(t[ids[:, j]] for j, t in enumerate(m.tables))
    n, words = len(y), len(ids)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(words)
    doc = np.repeat(np.arange(n), np.diff(first))
    pooled, where = np.zeros((n, FILTERS * len(WIDTHS))), np.full((n, FILTERS * len(WIDTHS)), -1)
    for i, k in enumerate(m.kernels):
        out = np.tile(m.bias[i * FILTERS:(i + 1) * FILTERS], (words, 1)).astype(float)
        for j in range(len(k)):
            out[:words - j] += np.where((room > j)[:words - j, None], emb[j:] @ k[j], 0)
        top = segment_reduce(np.maximum, out, first, 0.0)
        for f in range(FILTERS):
            hit = np.flatnonzero(out[:, f] == top[doc, f])
            c = i * FILTERS + f
            where[doc[hit[::-1]], c] = hit[::-1]  # the first such word
            pooled[:, c] = np.maximum(top[:, f], 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ m.out + m.out_bias, -30, 30)))
    err = (p - y) * weight / n
    bias, kernels, hit_at, hit_by = np.zeros(len(m.bias)), [], [np.zeros(0, np.int64)], [np.zeros((0, EMBED))]
    back = err[:, None] * m.out[None] * (pooled > 0) * (where >= 0)
    for i, k in enumerate(m.kernels):
        g = 1e-3 * k
        for f in range(FILTERS):
            c = i * FILTERS + f
            on = back[:, c] != 0
            bias[c] = back[on, c].sum()
            for j in range(len(k)):
                at = where[on, c] + j
                ok = at < first[1:][on]
                g[j, :, f] += back[on, c][ok] @ emb[at[ok]]
                hit_at.append(at[ok])
                hit_by.append(back[on, c][ok, None] * k[j, :, f])
        kernels.append(g.ravel())
    vector = np.concatenate([pooled.T @ err + 1e-3 * m.out, bias, *kernels, [err.sum()]])
    return vector, np.concatenate(hit_at), np.concatenate(hit_by)


def _logit(p):
    return np.log(p / (1 - p))


def _best_cut(rows: np.ndarray, hits: np.ndarray, prior: float, trust: float = 3.0) -> float:
    """The log odds of best F1 from the rows and the toxic rows of each score bin, drawn to
    ``prior`` where few rows bear the label."""
    n = hits.sum()
    if not (0 < n < rows.sum()):
        return prior
    at = np.flatnonzero(rows)[::-1]
    f1 = 2 * np.cumsum(hits[at]) / (np.cumsum(rows[at]) + n)
    best = int(f1.argmax())
    low = at[best + 1] if best + 1 < len(at) else at[best] - 1
    cut = ((at[best] + low) / 2 + 0.5) / BINS * 2 * REACH - REACH
    return float((cut * n + prior * trust) / (n + trust))


def _sample(docs: DataFrame, y: DataFrame, sample_rows: int) -> DataFrame:
    """(shard, half, y, ids: word ids) of labelled texts of ``docs``, staged: of each class
    those of least hash of id and text, ``sample_rows`` and what the last hash bucket has over
    that.  Equal rows count once; many texts under one id spread over the buckets.  Texts stay
    on the executors."""
    key = F.xxhash64(F.col("doc_id").cast("string"))
    small = docs.select("doc_id", F.xxhash64("text").alias("h")).join(y, "doc_id").distinct() \
        .withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "h"), F.lit(BUCKETS)))
    held = stage(small, "toxic-labelled")
    per = held.groupBy("y", "bucket").agg(F.count(F.lit(1)).alias("n")).collect()  # 2 * BUCKETS rows at most
    last = {}
    for v in (0, 1):
        n = np.bincount([r["bucket"] for r in per if r["y"] == v], [r["n"] for r in per if r["y"] == v], BUCKETS)
        last[v] = int(min(np.searchsorted(np.cumsum(n), sample_rows), BUCKETS - 1))
    chosen = held.where(F.col("bucket") <= F.when(F.col("y") == 1, last[1]).otherwise(last[0]))
    rows = (docs.withColumn("h", F.xxhash64("text"))
            .join(F.broadcast(chosen.select("doc_id", "h", "y")), ["doc_id", "h"])  # small rows of the sample
            .withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "doc_id", "h"), F.lit(SHARDS)).cast("int"))
            .withColumn("half", _half("doc_id")))

    def run(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            ids, first, _ = word_ids(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("shard", "half", "y", "key", "h")],
                 pa.array([ids[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                names=["shard", "half", "y", "key", "h", "ids"])

    told = rows.select("shard", "half", "y", key.alias("key"), "h", "text") \
        .mapInArrow(run, "shard int, half int, y int, key long, h long, ids binary")
    return stage(told.dropDuplicates(["key", "h"]).repartition(SHARDS, "shard")
                 .sortWithinPartitions("shard", F.xxhash64("key", "h")).select("shard", "half", "y", "ids"), "toxic-sample")


def _half(id_col: str):
    return F.pmod(F.xxhash64(F.lit(3), F.col(id_col).cast("string")), F.lit(2)).cast("int")


def _histograms(docs: DataFrame, y: DataFrame, halves: list[Model]) -> np.ndarray:
    """Label x language x score bin: all labelled rows of ``docs``, each scored by the model
    of the other half.  Small rows only are joined with the labels."""
    def run(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            ids, first, lang = word_ids(*text_bytes(part.column("text")))
            half = part.column("half").to_numpy()
            p = np.zeros(part.num_rows)
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                if len(at):
                    p[at] = halves[1 - h].probability(*_pick(ids, first, at))
            place = (_logit(np.clip(p, 1e-6, 1 - 1e-6)) + REACH) / (2 * REACH) * BINS
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(lang.astype(np.int32)), pa.array(place.astype(np.int32))],
                names=["doc_id", "lang", "bin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scores = docs.where(F.col("doc_id").isNotNull()).withColumn("half", _half("doc_id")) \
        .mapInArrow(run, f"doc_id {kind}, lang int, bin int")
    out = np.zeros((2, len(LANGS), BINS))
    for r in scores.join(y, "doc_id").groupBy("y", "lang", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["y"], r["lang"], r["bin"]] = r["n"]  # at most as many rows as the array has places
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Filters are learned on Spark from about ``sample_rows`` labelled documents of each
    class, those of least hashed id among the rows of ``docs``, whole texts.  The languages'
    cuts come from the scores of all labelled rows, as common as each class is in them, by
    models that learned from the other half of the ids.

    Null ids, labels and repeated labels (the largest counts) are allowed; without both
    classes every text scores 0.1."""
    y = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _sample(texts, y, sample_rows)
    n, seen = _counted(rows)
    if not n.sum(0).all():
        return Model()
    starts = [(_start(seen.sum(0), n.sum(0)), (0, 1), n.sum(0)[1] / n.sum())]
    crossed = bool(n.all())  # both halves have both classes
    if crossed:
        starts += [(_start(seen[h], n[h]), (h,), n[h][1] / n[h].sum()) for h in (0, 1)]
    del seen
    model, *halves = train(rows, starts)
    neg, pos = _histograms(texts, y, halves) if crossed else np.zeros((2, len(LANGS), BINS))
    overall = _best_cut((neg + pos).sum(0), pos.sum(0), 0.0)
    cuts = [_best_cut(neg[i] + pos[i], pos[i], overall) for i in range(len(LANGS))]
    model.cuts = 1 / (1 + np.exp(-np.clip(cuts, -8, 8)))
    return model


def _scored(docs: DataFrame, model: Model, text_col: str, emit, schema) -> DataFrame:
    def run(batches):
        for part in by_bytes(batches, text_col, BATCH_BYTES):
            yield emit(part, model.score(*text_bytes(part.column(text_col))))

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null and empty texts are scored as texts without
    words, repeated rows one by one; other columns are not read.  No shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _scored(rows, model, "text", lambda part, s: pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(s)], names=["doc_id", "score"]), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below ``threshold``, all columns as they were; no shuffle."""
    return _scored(docs, model, text_col, lambda part, s: part.filter(pa.array(s < threshold)), docs.schema)
