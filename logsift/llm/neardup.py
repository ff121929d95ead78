"""MinHash near-duplicates (operator 8): universal-hash minima, banding, signature
check, confirmation on full shingle sets, components by alternating stars.

Documents with equal shingle sets are one class, found by grouping on a 128-bit
fingerprint.  Classes that share a band are compared with the band's least class first;
after those links are joined to components, only pairs that lie in different components
are looked at, in blocks of bounded size, and only links that tie components are passed on.  So a group of near copies costs work in
proportion to its size, and no pair that a band proposes stays unexamined unless its
ends are already linked or its distances to the band's least class rule it out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logsift.llm.common import by_bytes, partitions, release_memory, stage, text_bytes
from logsift.llm.components import components
from logsift.llm.words import lower_words, mix, segment_reduce, shingles

BATCH_BYTES = 1 << 20
BANDS, ROWS = 32, 4  # a pair at 0.75 shares a band but for 5 in a million
PERMS = BANDS * ROWS
#: Agreement of two signatures below which a pair can't be linked: 4.4 standard errors
#: under 0.75.  CLOSE is 1 - 0.75, the largest distance of a link, plus as much for error.
AGREE, CLOSE = 0.58, 0.5
CLASS = "__shingle_class"  # column while rows are chosen
BLOCK = 1024  # classes of a bucket that are compared at a time
SHINGLES = 1 << 20  # of a group's texts that are matched at a time, about
_A = mix(np.arange(PERMS, dtype=np.uint64), 21) | np.uint64(1)
_B = mix(np.arange(PERMS, dtype=np.uint64), 22)


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minimum of each universal hash (multiply, add, upper half) over each set."""
    out = np.empty((len(off) - 1, PERMS), np.uint32)
    for a in range(0, len(off) - 1, 256):  # small enough to stay in the cache
        b = min(a + 256, len(off) - 1)
        part, at = h[off[a]:off[b]], off[a:b + 1] - off[a]
        for k in range(PERMS):
            out[a:b, k] = segment_reduce(np.minimum, ((part * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32),
                                         at, np.uint32(0xFFFFFFFF))
    return out


def _sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*lower_words(*text_bytes(col)))


def _sets_in_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``_sets`` of many texts, BATCH_BYTES of them hashed at a time: what hashing needs
    besides its result doesn't grow with the group."""
    rows = pa.RecordBatch.from_arrays([texts], names=["text"])
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)] if len(texts) else [0]
    parts = [_sets(rows.column(0).slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]
    return (np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]]),
            np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *[np.diff(o) for _, o in parts]]))]))


def _fingerprint(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(segment_reduce(np.add, mix(h, s), off, np.uint64(0)).view(np.int64) for s in (31, 32))


def _blobs(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    off = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, off, pa.py_buffer(rows)])


def _matrix(col: pa.Array) -> np.ndarray:
    buf, off = np.frombuffer(col.buffers()[2], np.uint8), np.frombuffer(col.buffers()[1], np.int32)
    a, b = off[col.offset], off[col.offset + len(col)]
    return buf[a:b].view(np.uint32).reshape(len(col), PERMS)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, lo, hi: fingerprint of the set, sig) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for part in by_bytes(batches, "text", BATCH_BYTES):
            h, off = _sets(part.column("text"))
            lo, hi = _fingerprint(h, off)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(off)), pa.array(lo), pa.array(hi), _blobs(signatures(h, off))],
                names=["doc_id", "n_shingles", "lo", "hi", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, lo long, hi long, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, cls): a class's key in each of the bands."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = _matrix(b.column("sig")).astype(np.uint64).reshape(b.num_rows, BANDS, ROWS)
            key = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64), 41), (b.num_rows, BANDS))
            for r in range(ROWS):
                key = mix(key ^ sig[:, :, r], r)
            key = key >> np.uint64(5) << np.uint64(5) | np.arange(BANDS, dtype=np.uint64)  # the last bits: which band
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(), BANDS))],
                names=["band", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "band long, cls long")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (cls, center) with the share of equal minima of their signatures."""
    sig = classes.select("cls", "sig")
    both = (pairs.join(sig, "cls")
            .join(sig.select(F.col("cls").alias("center"), F.col("sig").alias("other")), "center"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                same = (_matrix(b.column("sig")) == _matrix(b.column("other"))).mean(1)
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("center"), pa.array(same)],
                                                 names=["cls", "center", "agree"])

    return both.select("cls", "center", "sig", "other").mapInArrow(run, "cls long, center long, agree double")


def _texts(docs: DataFrame, classes: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cls, text) of the needed classes: the text of a class's least document."""
    wanted = classes.join(needed, "cls").select("cls", F.col("doc").alias("doc_id"))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .join(wanted, "doc_id").select("cls", "text")


def _confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity.  A text that isn't
    its class's own (another row with the same id) fails the fingerprint and is passed over."""
    rows = (pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb"))

    def run(batches):
        for part in by_bytes(batches, ("ta", "tb"), 2 * BATCH_BYTES):
            ha, oa = _sets(part.column("ta"))
            hb, ob = _sets(part.column("tb"))
            a, b = (part.column(c).to_numpy() for c in "ab")
            own = (_fingerprint(ha, oa)[0] == a) & (_fingerprint(hb, ob)[0] == b)
            row = np.repeat(np.arange(len(a)), np.diff(oa)), np.repeat(np.arange(len(b)), np.diff(ob))
            key, at = np.concatenate([ha, hb]), np.concatenate(row)
            order = np.lexsort((key, at))
            key, at = key[order], at[order]
            both = np.bincount(at[1:][(key[1:] == key[:-1]) & (at[1:] == at[:-1])], minlength=len(a))
            union = np.diff(oa) + np.diff(ob) - both
            ok = own & (den * both >= num * union)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Rows (band, i, j, side, cls, comp) that have a partner in their group (band, i, j), of
    another component, with which their signature agrees.

    ``members``: (band, cls, comp, near: agreement with the band's least class, minor: not
    of that class's component).  Minor members meet all members of their band, in groups of
    at most 2 * BLOCK rows: each minor's block meets each block of the whole."""
    size = members.groupBy("band").agg(
        F.max(F.when(F.col("minor"), F.col("near"))).alias("far"), F.sum(F.col("minor").cast("long")).alias("n_minor"))
    kept = (members.join(size.where("n_minor > 0"), "band")
            .where(F.col("minor") | (F.col("near") <= F.col("far") + CLOSE)))
    count = kept.groupBy("band").agg(F.count(F.lit(1)).alias("n_all"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    kept = kept.join(count.where("c0 <> c1"), "band").join(classes.select("cls", "sig"), "cls")
    blocks = lambda c: F.expr(f"cast(({c} + {BLOCK - 1}) div {BLOCK} as int)")
    own = lambda c: F.pmod(F.xxhash64("cls"), blocks(c)).cast("int")
    left = kept.where("minor").select("band", own("n_minor").alias("i"),
                                      F.explode(F.sequence(F.lit(0), blocks("n_all") - 1)).alias("j"),
                                      F.lit(0).alias("side"), "cls", "comp", "near", "sig")
    right = kept.select("band", F.explode(F.sequence(F.lit(0), blocks("n_minor") - 1)).alias("i"),
                        own("n_all").alias("j"), F.lit(1).alias("side"), "cls", "comp", "near", "sig")
    rows = left.unionAll(right).repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side")

    def propose(t: pa.Table):
        """Rows with a partner whose signature agrees and with which this is the first
        band in common, so that a pair comes up once."""
        col = {c: t.column(c).to_numpy() for c in ("band", "side", "cls", "comp", "near")}
        sig = _matrix(t.column("sig").combine_chunks())
        start, end = _groups(t)
        group = np.repeat(np.arange(len(start)), end - start)
        n_left = np.bincount(group[col["side"] == 0], minlength=len(start))
        each = np.where(col["side"] == 0, (end - start - n_left)[group], 0)  # right rows met by each left row
        met = np.cumsum(each)
        found = np.zeros(t.num_rows, bool)
        for a in range(0, int(met[-1]), 1 << 15):
            k = np.arange(a, min(a + (1 << 15), int(met[-1])))
            x = np.searchsorted(met, k, "right")
            y = start[group[x]] + n_left[group[x]] + (k - (met[x] - each[x]))
            ok = (col["comp"][x] != col["comp"][y]) & (np.abs(col["near"][x] - col["near"][y]) <= CLOSE)
            x, y = x[ok], y[ok]
            same = sig[x] == sig[y]
            first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == col["band"][x] % BANDS
            ok = first & (same.mean(1) >= AGREE)
            found[x[ok]] = found[y[ok]] = True
        t = t.select(["band", "i", "j", "side", "cls", "comp"]).filter(pa.array(found))
        yield from t.combine_chunks().to_batches()

    return rows.mapInArrow(lambda batches: _by_group(batches, propose),
                           "band long, i int, j int, side int, cls long, comp long")


def _exact(rows: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the left and the right rows of each group, confirmed on full
    sets; of each group only as many as tie its components together."""
    ready = rows.join(texts, "cls").repartition(n, "band", "i", "j").sortWithinPartitions("band", "i", "j", "side")

    def confirm(t: pa.Table):
        side, cls, comp = (t.column(c).to_numpy() for c in ("side", "cls", "comp"))
        for s, e in zip(*_groups(t)):
            h, off = _sets_in_slices(t.column("text").slice(s, e - s).combine_chunks())
            own = _fingerprint(h, off)[0] == cls[s:e]
            size, at = np.diff(off), np.repeat(np.arange(e - s, dtype=np.int32), np.diff(off))
            left, right = np.flatnonzero((side[s:e] == 0) & own), np.flatnonzero((side[s:e] == 1) & own)
            both = np.zeros((len(left), len(right)), np.float32)
            bits = max(0, (len(h) // SHINGLES).bit_length())
            for k in range(1 << bits):  # shingles by the first bits of their hash
                mine = np.flatnonzero(h >> np.uint64(64 - bits) == k) if bits else slice(None)
                _, code, count = np.unique(h[mine], return_inverse=True, return_counts=True)
                shared = count[code] > 1
                code, row = np.unique(code[shared], return_inverse=True)[1], at[mine][shared]
                for a in range(0, int(code.max()) + 1 if len(code) else 0, 4096):  # columns of the incidence matrix
                    part = (code >= a) & (code < a + 4096)
                    held = np.zeros((e - s, min(4096, int(code.max()) + 1 - a)), np.float32)
                    held[row[part], code[part] - a] = 1
                    both += held[left] @ held[right].T
            union = size[left][:, None] + size[right][None] - both
            x, y = np.nonzero((den * both >= num * union) & (comp[s:e][left][:, None] != comp[s:e][right][None]))
            root = {int(c): int(c) for c in comp[s:e]}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            links = []
            for p, q in zip(left[x], right[y]):
                cp, cq = find(int(comp[s + p])), find(int(comp[s + q]))
                if cp != cq:
                    root[cp] = cq
                    links.append((int(cls[s + p]), int(cls[s + q])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return ready.mapInArrow(lambda batches: _by_group(batches, confirm), "a long, b long")


def _groups(t) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of equal (band, i, j)."""
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in ("band", "i", "j"):
        v = t.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], t.num_rows)


def _by_group(batches, work):
    """``work`` on tables of whole groups, from sorted batches."""
    held: list[pa.RecordBatch] = []
    try:
        yield from _whole_groups(batches, work, held)
    finally:
        held.clear()
        release_memory()


def _whole_groups(batches, work, held: list):
    for b in batches:
        if not b.num_rows:
            continue
        start = _groups(b)[0]
        if not held or all(held[-1].column(c)[-1] == b.column(c)[0] for c in ("band", "i", "j")):
            start = start[1:]  # the first group began earlier or begins the rows
        if len(start):  # all before the last start is whole groups
            whole = [*held, b.slice(0, int(start[-1]))]
            yield from work(pa.Table.from_batches([w for w in whole if w.num_rows]))
            held[:] = [b.slice(int(start[-1]))]
        else:
            held.append(b)
    if held:
        yield from work(pa.Table.from_batches(held))


def classes_of(sketches: DataFrame) -> DataFrame:
    """(cls, doc: least id, row: its first row, sig) of each distinct, non-empty shingle set."""
    return (sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("lo", "hi")
            .agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("sig").alias("sig"))
            .select(F.col("lo").alias("cls"), F.col("least.doc_id").alias("doc"), "least.row", "sig"))


def link(docs: DataFrame, classes: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(node, component) over the classes that have links of similarity num/den or more."""
    n = partitions(docs.sparkSession)
    bands = _bands(classes)
    shared = bands.groupBy("band").agg(F.min("cls").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1")
    spokes = stage(bands.join(shared.select("band", "center"), "band").where("cls <> center"), "spokes")
    agree = stage(_agreement(spokes.select("cls", "center").distinct(), classes), "agree")
    likely = agree.where(F.col("agree") >= AGREE).select(F.col("cls").alias("a"), F.col("center").alias("b"))

    # a class and the least class of its band, wherever their signatures agree
    needed = likely.select(F.col("a").alias("cls")).unionAll(likely.select(F.col("b").alias("cls"))).distinct()
    texts = stage(_texts(docs, classes, needed, id_col, text_col), "texts")
    links = stage(_confirmed(likely, texts, num, den), "links")
    comp = stage(components(links), "comp")

    # every other pair of a band whose ends are still apart
    near = spokes.join(agree, ["cls", "center"]).select("band", "cls", "center", F.col("agree").alias("near"))
    members = _placed(_placed(near, comp, "cls"), comp, "center").select(
        "band", "cls", F.col("cls_comp").alias("comp"), "near", (F.col("cls_comp") != F.col("center_comp")).alias("minor"))
    more = stage(_across(stage(members, "members"), classes, n), "open-pairs")
    if more.isEmpty():
        return comp
    lacking = more.select("cls").distinct().join(texts.select("cls"), "cls", "left_anti")
    texts = texts.unionAll(stage(_texts(docs, classes, lacking, id_col, text_col), "more-texts"))
    links = stage(links.unionAll(_exact(more, texts, n, num, den)), "links")
    return components(links)


def _placed(rows: DataFrame, comp: DataFrame, c: str) -> DataFrame:
    """``rows`` with the component of class column ``c`` (its own where it has no link)."""
    return rows.join(comp.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp")), c, "left") \
        .withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))


def _grouped(docs: DataFrame, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, lo: class, component_id, alone: without a group, kept: the one row of
    its group that stays, of every row."""
    sketches = stage(sketch(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    classes = stage(classes_of(sketches), "classes")
    comp = link(docs, classes, num, den, id_col, text_col)
    named = stage(classes.select("cls", "doc", "row").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
                  .select("cls", "doc", "row", F.coalesce("component", "cls").alias("comp")), "named")
    least = named.groupBy("comp").agg(F.min(F.struct("doc", "row")).alias("least"))
    of = named.join(least, "comp").select(F.col("cls").alias("lo"), F.col("least.doc").alias("component_id"),
                                          F.col("least.row").alias("stays"))
    out = sketches.select("doc_id", "n_shingles", "lo", "row").join(of, "lo", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "lo", component.alias("component_id"), alone.alias("alone"),
                      (alone | (F.col("row") == F.col("stays"))).alias("kept"))


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Linked: den * |A and B| >= num * |A or B| on the sets of 5-word shingles of the whole,
    A-Z-lowered texts.  component_id is the least doc_id reachable and kept says doc_id = component_id,
    so repeats of a group's least id are all kept (``keep_one`` leaves one row).  Null, empty and wordless texts have no shingles and
    stand alone; rows with a null id link nothing, have a null component_id and are kept;
    repeated rows each get a row; rows of one id with different texts are grouped each by
    its own text.  Columns other than id and text are not read."""
    return _grouped(docs, num, den, id_col, text_col).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _with_class(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the class of each row's text as column CLASS."""
    def run(batches):
        for part in by_bytes(batches, text_col, BATCH_BYTES):
            lo = _fingerprint(*_sets(part.column(text_col)))[0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lo)], names=[*part.schema.names, CLASS])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(CLASS, LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", num: int = 75, den: int = 100, text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, all columns as they were.  Rows are told
    apart by id and shingle set, so another text under the same id stays; of rows equal in
    both, any one stays.  Rows without a group all stay."""
    key = [id_col, CLASS]
    fate = (_grouped(docs, num, den, id_col, text_col).where(~F.col("alone"))
            .groupBy(F.col("doc_id").alias(id_col), F.col("lo").alias(CLASS))
            .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")))
    fate = stage(fate.where(~F.col("stays") | (F.col("n") > 1)), "fate")
    twice = fate.where("stays").select(*key)
    once = _with_class(docs, text_col).join(fate.select(*key), key, "left_anti")
    repeated = docs.join(twice.select(id_col).distinct(), id_col, "left_semi").select(*docs.columns)
    one = _with_class(repeated, text_col).join(twice, key, "left_semi").dropDuplicates(key)
    return once.select(*docs.columns).unionAll(one.select(*docs.columns))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT d.r, any_value(d.doc_id) AS doc_id, count(s.r) AS n_shingles FROM d LEFT JOIN s ON d.r = s.r GROUP BY d.r
), links AS MATERIALIZED (
  SELECT x.r AS a, y.r AS b
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r
       JOIN n p ON p.r = x.r JOIN n q ON q.r = y.r
  WHERE p.doc_id IS NOT NULL AND q.doc_id IS NOT NULL
  GROUP BY x.r, y.r
  HAVING 100 * count(*) >= 75 * (any_value(p.n_shingles) + any_value(q.n_shingles) - count(*))
), reach(a, b) AS (
  SELECT r, r FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a, min(n.doc_id) AS component_id FROM reach JOIN n ON n.r = reach.b GROUP BY a)
SELECT n.doc_id, n.n_shingles, least.component_id, n.doc_id IS NOT DISTINCT FROM least.component_id AS kept
FROM n JOIN least ON least.a = n.r
"""
