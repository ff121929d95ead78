"""Fill-in-the-middle (operator 13): texts are cut in three and put in another order.

A text is looked at in fixed blocks of bytes.  A Fenwick tree over the blocks holds how
many units (code points or words) and code points they have; binary lifting descends it
to the block that holds a cut, and the cut's byte is then found inside that block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import by_bytes, text_bytes
from logsift.llm.words import word_spans

BATCH_BYTES = 4 << 20
BLOCK = 4096  # bytes of a tree's leaf
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BlockTree:
    """Fenwick tree over a text's blocks; row i of ``tree`` sums the (units, code points)
    of the blocks that end with the i-th and begin after i without its lowest bit."""

    def __init__(self, counts: np.ndarray):
        self.m = len(counts)
        self.tree = np.zeros((self.m + 1, 2), np.int64)
        self.tree[1:] = counts
        half = 1
        while 2 * half <= self.m:  # a node takes the lower half of its range from another
            at = np.arange(2 * half, self.m + 1, 2 * half)
            self.tree[at] += self.tree[at - half]
            half *= 2

    def find(self, units: int) -> tuple[int, int, int]:
        """(block, units left, code points before) of the block that holds unit ``units``
        (from 0): as many whole blocks as hold that many units or fewer are stepped over."""
        at, points, step = 0, 0, 1 << self.m.bit_length()
        while step := step >> 1:
            if at + step <= self.m and self.tree[at + step, 0] <= units:
                at += step
                units -= int(self.tree[at, 0])
                points += int(self.tree[at, 1])
        return at, units, points

    def total(self) -> tuple[int, int]:
        """(units, code points) of the text."""
        at, units, points = self.m, 0, 0
        while at:
            units, points = units + int(self.tree[at, 0]), points + int(self.tree[at, 1])
            at &= at - 1
        return units, points


def unit_starts(buf: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes at which a unit begins, bytes at which a code point begins).  A ``word`` is a
    run of non-blanks with the blanks after it; a text's first one takes those before it."""
    points = (buf & 0xC0) != 0x80
    if unit == "codepoint":
        return points, points
    if unit != "word":
        raise ValueError(f"unit must be codepoint or word, not {unit}")
    begins, _, first = word_spans(buf, off)
    starts = np.zeros(len(buf), bool)
    starts[begins] = True
    led = np.flatnonzero(np.diff(off) > 0)
    has = first[led + 1] > first[led]
    starts[begins[first[led[has]]]] = False
    starts[off[led]] = True
    return starts, points


def block_counts(starts: np.ndarray, points: np.ndarray, off: np.ndarray, block: int):
    """((units, code points) of every block of every text, first block of each text)."""
    n = -(-np.diff(off) // block)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(off[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * block
    if not len(at):
        return np.zeros((0, 2), np.int64), first
    return np.stack([np.add.reduceat(f.astype(np.int64), at) for f in (starts, points)], 1), first


def _cut(tree: BlockTree, units: int, starts: np.ndarray, points: np.ndarray, a: int, b: int, block: int) -> tuple[int, int]:
    """(byte, code points before it) of the cut after ``units`` units of the text a:b."""
    if units >= tree.total()[0]:
        return b, tree.total()[1]
    at, left, before = tree.find(units)
    s = a + at * block
    here = s + int(np.flatnonzero(starts[s:min(s + block, b)])[left])
    return here, before + int(np.count_nonzero(points[s:here]))


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "codepoint", rate: int = 90, spm: int = 20,
                   block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain),
    output of every row.

    h1 to h4 are the first four 8-digit groups of the hex sha256 of ``seed:doc_id``.  The
    prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units, the middle after
    the larger.  A text stays ``plain`` if it is empty, holds one of the marks, or if
    h3 % 100 >= rate; else it is ``spm`` if h4 % 100 < spm, else ``psm``.

    A null text counts as empty; a null id as an empty one in the hash, and stays null;
    repeated rows each get the same row; texts of any length are cut whole, in batches by
    bytes, a longer text alone; an empty table gives no rows.  Other columns are not read.
    No shuffle."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias("digest"))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def turn(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            buf, off = text_bytes(part.column("text"))
            starts, points = unit_starts(buf, off, unit)
            counts, first = block_counts(starts, points, off, block)
            raw, out = buf.tobytes(), []
            for i, digest in enumerate(part.column("digest").to_pylist()):
                a, b = int(off[i]), int(off[i + 1])
                tree = BlockTree(counts[first[i]:first[i + 1]])
                n = tree.total()[0]
                h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
                text = raw[a:b]
                if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
                    out.append((n, "plain", None, None, text))
                    continue
                u, v = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                (x, px), (y, py) = (_cut(tree, k, starts, points, a, b, block) for k in (u, v))
                pre, mid, suf = raw[a:x], raw[x:y], raw[y:b]
                if h[3] % 100 < spm:
                    out.append((n, "spm", px, py - px, b"".join([marks[1], suf, marks[0], pre, marks[2], mid])))
                else:
                    out.append((n, "psm", px, py - px, b"".join([marks[0], pre, marks[1], suf, marks[2], mid])))
            n, form, pre, mid, text = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(form), pa.array(pre, pa.int64()),
                 pa.array(mid, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(turn, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by its form alone: the marks occur in no
    text that was cut, so they tell its parts apart."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
            .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))


def digest(turned: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with sha256 sums in place of the output."""
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                         F.sha2("output", 256).alias("output_sha256"),
                         F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS u, greatest(h1 % (n + 1), h2 % (n + 1)) AS v,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, u) AS pre, substr(text, u + 1, v - u) AS mid, substr(text, v + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN u END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN v - u END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
