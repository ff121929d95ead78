"""Benchmark decontamination (operator 5): pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; any text within k
edits of it holds one piece unchanged.  All pieces are searched at once (Aho-Corasick)
and each hit's neighbourhood is checked with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes

BATCH_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20  # of benchmark text that is searched for in one pass over the documents
ERROR_RATE = 0.05  # edits allowed per character of an item
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case, letters and digits kept, everything else one blank; a blank at both ends."""
    return f" {_OTHER.sub(' ', (text or '').lower()).strip()} "


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``k + 1`` pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` inside ``text`` with at most ``k``
    edits, the first such end; None if there is none."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    pv, mv, dist, best = mask, 0, m, None
    for j, ch in enumerate(text):
        eq = where.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        dist += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if dist <= k and (best is None or dist < best[0]):
            best = dist, j + 1
    return best


class Searcher:
    """All pieces of a block of items, and the search of one text for them."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick
        self.items, self.found = [], ahocorasick.Automaton()
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalise(text)
            k = int(rate * (len(item) - 2))
            item = item.strip() if k else item  # a short item must match as whole words
            if not item.strip():
                continue
            for at, piece in pieces(item, k):
                by_piece.setdefault(piece, []).append((len(self.items), at + len(piece)))
            self.items.append((item_id, item, k))
        for piece, of in by_piece.items():
            self.found.add_word(piece, of)
        self.any = bool(by_piece)
        if self.any:
            self.found.make_automaton()

    def search(self, text: str | None) -> Iterator[tuple]:
        """(item_id, distance, end in the normalised text) of every item found, once each."""
        if not self.any or not text:
            return
        text = normalise(text)
        spans: dict[int, list[list[int]]] = {}
        for end, of in self.found.iter(text):
            for i, reach in of:
                _, item, k = self.items[i]
                a = end + 1 - reach - k
                b = a + len(item) + 2 * k
                mine = spans.setdefault(i, [])
                if mine and a <= mine[-1][1] and b >= mine[-1][0]:
                    mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
                else:
                    mine.append([a, b])
        for i, places in spans.items():
            item_id, item, k = self.items[i]
            best = None
            for a, b in places:
                a = max(a, 0)
                at = text.find(item, a, b)
                got = (0, at + len(item)) if at >= 0 else (myers(item, text[a:b], k) if k else None)
                if got and at < 0:
                    got = got[0], got[1] + a
                if got and (best is None or got < best):
                    best = got
            if best:
                yield item_id, *best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_bytes``, each brought over on its own."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")) \
        .where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()]


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, end) of every item that a document holds within
    ``floor(rate * length)`` edits, both normalised; its best place, the first if several.

    The whole text is searched.  Null and empty documents and items match nothing; items too
    short for an edit must stand there exactly, as whole words; repeated rows each get their
    rows; an empty benchmark gives none.  Other columns are not read.  One pass over the
    documents per ``block_bytes`` of benchmark, no shuffle."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    doc_type, item_type = rows.schema["doc_id"].dataType, benchmark.schema[item_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(doc_type), to_arrow_type(item_type), pa.int32(), pa.int64()]
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, distance int, end long"
    out = None
    for block in _blocks(benchmark, item_col, text_col="text", block_bytes=block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            finder = Searcher(sent.value, rate)
            for part in by_bytes(batches, "text", BATCH_BYTES):
                got = [(doc, *hit) for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                       for hit in finder.search(text)]
                cols = list(zip(*got)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                 names=["doc_id", "item_id", "distance", "end"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text",
                        item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no benchmark item, all columns as they were; no shuffle."""
    for block in _blocks(benchmark, item_col, "text", block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            finder = Searcher(sent.value, rate)
            for part in by_bytes(batches, text_col, BATCH_BYTES):
                clean = [next(finder.search(t), None) is None for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
