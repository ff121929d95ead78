"""Quality classifier (operator 7): random Fourier features of document statistics,
ridge regression by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, merged, stage, text_bytes
from logsift.llm.words import LOWER, segment_reduce, word_hashes, word_spans

BATCH_BYTES = 1 << 20
FOURIER = 160  # random features
BINS = 2000  # of the raw score, for the calibration
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\v\f", b"\n",
            b".", b",;:", b"!?", b"|", b"#$%&*+=~^_", b"()[]{}<>", b"\"'`", b"-/\\@", bytes(range(128, 256))]


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per text: shares of byte classes, word and line shape,
    repetition of words, word pairs and lines.  Finite for any text, empty ones too."""
    n = len(off) - 1
    size = np.diff(off)
    kind = np.full(256, len(_CLASSES))
    for i, chars in enumerate(_CLASSES):
        kind[list(chars)] = i
    doc = np.repeat(np.arange(n), size)
    width = len(_CLASSES) + 1
    counts = np.bincount(doc * width + kind[buf], minlength=n * width).reshape(n, width)
    cols = [np.log1p(size), *np.sqrt(counts / np.maximum(size, 1)[:, None]).T]
    low = LOWER[buf]
    s, e, first = word_spans(low, off)
    words = np.diff(first)
    some = np.maximum(words, 1)
    length = (e - s).astype(float)
    h = word_hashes(low, s, e)
    punct = np.zeros(256, bool)
    punct[list(b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~")] = True
    last = punct[low[e - 1]] if len(e) else np.zeros(0, bool)
    upper = (buf[s] >= 65) & (buf[s] <= 90) if len(s) else np.zeros(0, bool)
    second = (buf[np.minimum(s + 1, len(buf) - 1)] - 65 < 26) & upper if len(s) else upper
    sums = segment_reduce(np.add, np.stack([length, length ** 2, length <= 3, length >= 12, last, upper, second], 1)
                          if len(s) else np.zeros((0, 7)), first, 0.0) / some[:, None]
    cols += [np.log1p(words), sums[:, 0], np.sqrt(np.maximum(sums[:, 1] - sums[:, 0] ** 2, 0)), *sums[:, 2:].T]
    owner = np.repeat(np.arange(n), words)
    pair = h * np.uint64(3) + np.concatenate([h[1:], h[:1]]) if len(h) else h
    cols += [_distinct(h, owner, n) / some, _distinct(pair, owner, n) / some]
    newline = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([off[:-1][size > 0], newline[newline + 1 < len(buf)] + 1]))
    ends = np.concatenate([starts[1:], [len(buf)]]) if len(starts) else starts
    of = np.searchsorted(off, starts, "right") - 1
    lines = np.bincount(of, minlength=n) if len(starts) else np.zeros(n, int)
    cols += [np.log1p(lines), _distinct(word_hashes(buf, starts, ends), of, n) / np.maximum(lines, 1),
             np.log1p(size / np.maximum(lines, 1))]
    return np.stack(cols, 1).astype(np.float32)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=n).astype(float)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats as bytes of float32) of every row; null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            x = statistics(*text_bytes(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "stats"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, stats binary")


@dataclass
class Model:
    """Standardisation, Fourier weights, ridge coefficients, calibration points."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([np.ones((len(z), 1)), z * 0.1, wave], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a hundredth of it follows the raw score, so that rows on
        one step of the calibration keep their order."""
        raw = self.raw(x)
        step = np.interp(raw, self.knots, self.values) if len(self.knots) else np.full(len(raw), 0.5)
        return np.clip(0.99 * step + 0.01 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def _unpack(col: pa.Array) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(float)


def _summed(rows: DataFrame, part) -> np.ndarray | None:
    """Sum over all rows of ``part(stats, y)``, an array of fixed size: one per task, merged
    in rounds, of which only the last round's few come to the driver."""
    def partial(batches):
        total = None
        for b in batches:
            if b.num_rows:
                p = part(_unpack(b.column("stats")), b.column("y").to_numpy(zero_copy_only=False))
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def fold(t: pa.Table) -> dict[str, pa.Array]:
        total = sum(np.frombuffer(r) for r in t.column("total").to_pylist())
        return {"total": pa.array([total.tobytes()], pa.binary())}

    got = merged(rows.mapInArrow(partial, "total binary"), fold).collect()
    return sum(np.frombuffer(r["total"]) for r in got) if got else None


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, m in zip(y, w):
        blocks.append([v, m, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, m2, n2 = blocks.pop()
            v1, m1, n1 = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """Fit on all rows of ``stats`` whose doc_id has a label (doc_id, y), whatever their
    number: three passes over those rows' statistics, sums of fixed size from each.  The
    ridge penalty is the one of least generalised cross-validation error.  Null labels are
    left out; several labels of a document are averaged.  Without labels: 0.5 everywhere."""
    y = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    rows = stage(stats.join(y, "doc_id").select("stats", "y"), "quality-rows")
    moments = _summed(rows, lambda x, t: np.concatenate([[len(x)], x.sum(0), (x ** 2).sum(0)]))
    if moments is None:
        zero = np.zeros(1)
        d = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), zero, np.zeros(d + 2), zero[:0], zero[:0])
    n, d = moments[0], (len(moments) - 1) // 2
    mean = moments[1:d + 1] / n
    scale = np.maximum(np.sqrt(np.maximum(moments[d + 1:] / n - mean ** 2, 0)), 1e-3)
    rng = np.random.default_rng(17)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER),
                  np.zeros(0), np.zeros(0), np.zeros(0))

    def normal(x, t):
        z = np.concatenate([model.expand(x), t[:, None]], 1)
        return (z.T @ z).ravel()

    gram = _summed(rows, normal).reshape(d + FOURIER + 2, -1)
    values, vectors = np.linalg.eigh(gram[:-1, :-1])
    values, along = np.maximum(values, 0), vectors.T @ gram[:-1, -1]
    best = (np.inf, 1.0)
    for penalty in 10.0 ** np.arange(-4, 4):
        coef = along / (values + penalty)
        error = gram[-1, -1] - 2 * coef @ along + (values * coef ** 2).sum()
        free = max(n - (values / (values + penalty)).sum(), 1)
        best = min(best, (n * max(error, 1e-9) / free ** 2, penalty))
    model.beta = vectors @ (along / (values + best[1]))

    def histogram(x, t):
        at = np.clip(((model.raw(x) + 1) / 3 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, t, BINS)]).astype(float)

    hist = _summed(rows, histogram)
    weight, ones = hist[:BINS], hist[BINS:]
    used = np.flatnonzero(weight)
    model.knots = (used + 0.5) / BINS * 3 - 1
    model.values = isotonic(ones[used] / weight[used], weight[used])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``stats``."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(model.score(_unpack(b.column("stats"))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least ``threshold``, all columns as they were; no shuffle."""
    def run(batches):
        for part in by_bytes(batches, text_col, BATCH_BYTES):
            good = model.score(statistics(*text_bytes(part.column(text_col))).astype(float)) >= threshold
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
