"""Packing along a space-filling curve (operator 1).

Each document's tokens are hashed to a short vector, projected to a few dimensions
and placed on a Hilbert curve.  Documents are laid end to end in curve order, so
neighbours on the curve share sequences, and the stream is cut every ``seq_len``
tokens: only the very last sequence is padded."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, partitions, stage
from logsift.llm.tokenizing import encode_column, encoder

DIMS, BITS, WIDTH = 3, 10, 64  # curve dimensions, bits of each, hashed vector's width
ENCODE_BYTES = 3 << 20  # text that is encoded at a time
CUT_BYTES = 2 << 20  # of staged ids that are cut at a time
TASK_TOKENS = 16 << 20  # tokens of a task once the data outgrow the session's partitions


def hilbert_key(coords: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) with ``bits`` bits a dimension.

    Gray-code form: walk the bits from the top, undo the rotation and reflection that
    the higher bits caused, then interleave."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    fold = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        fold ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= fold
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Curve position of each document: signed feature hashing of its token ids to
    ``WIDTH`` numbers, normalised, projected by a fixed random matrix, quantised."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    slot = (mixed >> np.uint64(32)) % np.uint64(WIDTH)
    vec = np.bincount(doc * WIDTH + slot.astype(np.int64), sign, n * WIDTH).reshape(n, WIDTH)
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12)
    proj = vec @ np.random.default_rng(5).normal(size=(WIDTH, DIMS))
    cells = np.clip((proj + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1)  # unit vectors: about N(0, 1)
    return hilbert_key(cells.astype(np.int64), BITS)


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, curve, n_tokens, ids as little-endian bytes, 2 or 4 bytes an id)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches):
        enc = encoder(tokenizer)
        for part in by_bytes(batches, "text", ENCODE_BYTES):
            ids, off = encode_column(enc, part.column("text"), ENCODE_BYTES)
            n = np.diff(off) + 1
            ends = np.cumsum(n)
            out = np.full(ends[-1], end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            curve = curve_keys(ids, off)
            wide = "<u4" if out.max() > 0xFFFF else "<u2"
            raw, step = out.astype(wide).tobytes(), int(wide[-1])
            cuts = np.concatenate([[0], ends]) * step
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(curve), pa.array(n),
                 pa.array([raw[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["doc_id", "curve", "n_tokens", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, curve long, n_tokens long, ids binary")


def _key(curve: int, doc, row: int) -> tuple:
    """(curve, doc_id, row) with null ids first, as Spark sorts them."""
    return (curve, doc is not None, doc if doc is not None else 0, row)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, seq_len: int = 4096,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``seq_len`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length, ids (little
    endian unsigned 32-bit), doc_tokens, sequence_id, offset, curve.  Every id lies in
    exactly one piece; all sequences but the last are full.  A null or empty text is its
    end id alone.  Repeated rows are documents of their own; equal curve positions are
    ordered by doc_id (null first), repeated ids by the staged row's number, so a row that is
    repeated very often is dealt to many tasks.  Very long texts are cut into pieces.  An
    empty table gives no rows.  Columns other than id and text are not read.

    Tokens are staged once (2 bytes an id where they fit) and shuffled once.  The curve
    is cut into ranges of (curve, doc_id, row) from the small columns alone; only one row per
    range (bounded by the number of tasks) comes to the driver, to give each range the
    stream position at which it begins."""
    spark = docs.sparkSession
    tokens = stage(tokenise(docs, tokenizer, end_id, id_col, text_col)
                   .withColumn("row", F.monotonically_increasing_id()), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(partitions(spark), -(-total // TASK_TOKENS))
    ranges = (tokens.select("curve", "doc_id", "row", "n_tokens")
              .repartitionByRange(n, "curve", "doc_id", "row")
              .groupBy(F.spark_partition_id().alias("p"))
              .agg(F.min(F.struct("curve", "doc_id", "row")).alias("low"), F.sum("n_tokens").alias("n"))
              .collect())
    ranges = sorted(ranges, key=lambda r: r["p"]) or [{"low": (0, None, 0), "n": 0}]
    # a range holds the rows from its lowest (curve, doc_id, row) to the next range's
    lows = [tuple(r["low"]) for r in ranges]
    base = np.concatenate([[0], np.cumsum([r["n"] for r in ranges])]).tolist()
    keys = [_key(*low) for low in lows]

    @F.arrow_udf("int")
    def range_of(curve: pa.Array, doc: pa.Array, row: pa.Array) -> pa.Array:
        rows = zip(curve.to_pylist(), doc.to_pylist(), row.to_pylist())
        return pa.array([max(0, bisect_right(keys, _key(*r)) - 1) for r in rows], pa.int32())

    kind = tokens.schema["doc_id"].dataType
    laid = (tokens.withColumn("range", range_of("curve", "doc_id", "row"))
            .repartitionById(len(lows), F.col("range"))
            .sortWithinPartitions("range", "curve", "doc_id", "row"))

    def cut(batches):
        now, pos = -1, 0
        for batch in by_bytes(batches, "ids", CUT_BYTES):
            out = []
            for r, size, raw, doc, curve in zip(*[batch.column(k).to_pylist() for k in (
                    "range", "n_tokens", "ids", "doc_id", "curve")]):
                if r != now:
                    now, pos = r, base[r]
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * size else "<u4").astype("<u4").tobytes()
                start = 0
                while start < size:
                    room = min(size - start, seq_len - pos % seq_len)
                    out.append((doc, start, room, wide[4 * start:4 * (start + room)], size,
                                pos // seq_len, pos % seq_len, curve))
                    start, pos = start + room, pos + room
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"]
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
    return laid.mapInArrow(cut, f"doc_id {kind.simpleString()}, start long, length long, ids binary, "
                                "doc_tokens long, sequence_id long, offset long, curve long")


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
