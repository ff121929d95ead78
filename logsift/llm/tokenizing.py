"""Token counts of whole texts (operator 2) and the batch encoder behind it.

Texts go to the library in Arrow batches balanced by bytes.  Long texts are cut at
safe boundaries: places where the tokens of the parts are the tokens of the whole.
For a tokenizer that drops white space and never joins across it (``word_bpe_49k``)
every start of white space is such a place, and so is the step from an ASCII letter
or digit to punctuation; each distinct part is encoded once per batch and its ids are
gathered for every occurrence."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, text_bytes
from logsift.llm.words import IS_SPACE, LOWER

BATCH_BYTES = 6 << 20  # text handed over at a time
JOINED = 512  # parts that are encoded as one string
MEMO_BYTES = 64 << 20  # of the distinct parts a worker remembers, about; then it starts anew
PART_BYTES = 150  # what a remembered part costs besides its text and ids, about
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)  # without ' and | (contractions, special tokens)
_PUNCT[list(b'!"#$%&()*+,-./:;=?@[]\\^_`{}~')] = True


def tokenizer_path(name: str) -> str:
    """A vocabulary file's place: a path as it is, a bare name from the public set."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _pieces(buf: np.ndarray, off: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut one long text (``off`` of length 2) where white space begins, every
    ``size`` bytes or at the next such place."""
    space = IS_SPACE[buf]
    safe = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    at = 0
    while len(buf) - at > size:
        nxt = safe[np.searchsorted(safe, at + size):]
        if not len(nxt):
            break
        yield at, int(nxt[0])
        at = int(nxt[0])
    yield at, len(buf)


class _PartEncoder:
    """Tokenizer whose tokens never cross white space."""

    def __init__(self, tok, lower: bool):
        self.tok, self.lower = tok, lower
        self.clear()

    def clear(self) -> None:
        """Forget all parts: when they have grown too many."""
        self.memo: dict[str, int] = {}
        self.held = 0
        self.lens = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _parts(self, buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The parts (zero-copy slices of the buffer) and each text's first part."""
        if self.lower and b"<|" not in buf.tobytes():  # special strings keep their case
            buf = LOWER[buf]
        space, alnum = IS_SPACE[buf], _ALNUM[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | (alnum[:-1] & _PUNCT[buf[1:]])
        cut[off] = True
        starts = np.flatnonzero(cut[:-1])
        bounds = np.append(starts, len(buf)).astype(np.int64)
        arr = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                    [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
        return arr, np.searchsorted(starts, off)

    def _slots(self, buf, off) -> tuple[np.ndarray, np.ndarray]:
        parts, first = self._parts(buf, off)
        if self.held > MEMO_BYTES:
            self.clear()
        coded = parts.dictionary_encode()
        words = coded.dictionary.cast(pa.large_string()).to_pylist()
        slot = np.fromiter(map(self.memo.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = [words[i] for i in new]
            slot[new] = np.arange(len(self.lens), len(self.lens) + len(new))
            self.memo.update(zip(fresh, slot[new].tolist()))
            self.held += sum(map(len, fresh)) + PART_BYTES * len(fresh)
            done = [self._tokens(fresh[i:i + 16 * JOINED]) for i in range(0, len(fresh), 16 * JOINED)]
            self.lens, self.ids = (np.concatenate([old, *got]) for old, got in zip((self.lens, self.ids), zip(*done)))
        return slot[coded.indices.to_numpy()], first

    def _tokens(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each part, all their ids).  Parts are joined by line feeds,
        which no token crosses, and told apart by where their tokens begin."""
        joined = ["\n".join(parts[i:i + JOINED]) for i in range(0, len(parts), JOINED)]
        got = self.tok.encode_batch(joined, add_special_tokens=False)
        n = np.fromiter(map(len, got), np.int64, len(got))
        total = int(n.sum())
        ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32, total)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in got)), np.int64, 2 * total)
        # places in all strings laid end to end, one sign apart, as the parts are in a string
        size = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
        at = spans[::2] + np.repeat(np.cumsum(size) - size, n)
        begin = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        return np.diff(np.searchsorted(at, np.concatenate([[0], begin]))), ids

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all texts, offsets of each text's ids)."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        slot, first = self._slots(buf, off)
        n = self.lens[slot]
        ends = np.cumsum(n)
        begin = np.cumsum(self.lens) - self.lens
        where = np.repeat(begin[slot] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.ids[where], np.concatenate([[0], ends])[first]

    def count(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if not len(buf):
            return np.zeros(len(off) - 1, np.int64)
        slot, first = self._slots(buf, off)
        return np.diff(np.concatenate([[0], np.cumsum(self.lens[slot])])[first])


class _TextEncoder:
    """Any other tokenizer: whole texts, a batch at a time."""

    def __init__(self, batch):
        self.batch = batch

    def encode(self, buf, off):
        raw = buf.tobytes()
        ids = self.batch([raw[a:b].decode() for a, b in zip(off, off[1:])])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum()))
        return flat, np.concatenate([[0], np.cumsum(lens)])

    def count(self, buf, off):
        return np.diff(self.encode(buf, off)[1])

    def clear(self):
        pass


@functools.lru_cache(maxsize=2)
def encoder(name: str):
    """The encoder of a vocabulary file, made once per worker."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return _TextEncoder(lambda texts: sp.encode(texts, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert"):
        return _PartEncoder(tok, "Lowercase" in steps)
    return _TextEncoder(lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)])


def encode_column(enc, col: pa.Array, batch_bytes: int = BATCH_BYTES, counts_only: bool = False):
    """Tokens of each text of a column, long texts in parts: lengths, or (ids, offsets)."""
    buf, off = text_bytes(col)
    if len(buf) <= 2 * batch_bytes or isinstance(enc, _TextEncoder):
        return enc.count(buf, off) if counts_only else enc.encode(buf, off)
    lens, flat = np.zeros(len(off) - 1, np.int64), []
    for i, (a, b) in enumerate(zip(off, off[1:])):  # only batches with a very long text
        for s, e in _pieces(buf[a:b], off, batch_bytes):
            piece = buf[a + s:a + e]
            if counts_only:
                lens[i] += enc.count(piece, np.array([0, len(piece)]))[0]
            else:
                ids, _ = enc.encode(piece, np.array([0, len(piece)]))
                lens[i] += len(ids)
                flat.append(ids)
    if counts_only:
        return lens
    return np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(lens)])


def count_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Tokens of every whole text: id, n_bytes (UTF-8), n_tokens, over_limit.

    One row per input row, repeated rows too; a null or empty text has 0 bytes and 0
    tokens, a null id stays null.  No begin, end or added special tokens; special
    strings inside a text count as the library reads them.  Other columns of the
    input, whatever their names, are not read.  No shuffle."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def lengths(batches):
        enc = encoder(tokenizer)
        for part in by_bytes(batches, "text", batch_bytes):
            n = encode_column(enc, part.column("text"), batch_bytes, counts_only=True)
            size = np.diff(text_bytes(part.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()),
                 pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return rows.mapInArrow(lengths, schema)
