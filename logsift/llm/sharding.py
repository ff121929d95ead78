"""Sharding along a Hilbert curve over document metadata (operator 3).

Language, source and size are quantised at their own quantiles, joined to one curve
index and sorted, and the order is cut into runs.  Files of neighbouring runs share
narrow ranges of every dimension, so readers prune on any of them.  DataFrame
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import partitions, stage
from logsift.llm.mixing import prefix_sums


def hilbert_tables(dims: int) -> tuple[list[int], list[int]]:
    """Automaton of the curve: for state * 2**dims + cell, the digit and next state.

    A state is the corner at which the curve enters a cube and the axis along which it
    leaves; inside, cells are visited in Gray-code order, reflected and rotated so."""
    size = 1 << dims

    def rot(x: int, k: int) -> int:
        k %= dims
        return (x << k | x >> (dims - k)) & (size - 1)

    def gray(i: int) -> int:
        return i ^ i >> 1

    rank = {gray(i): i for i in range(size)}
    digits, nexts = [0] * (size * dims * size), [0] * (size * dims * size)
    for entry in range(size):
        for axis in range(dims):
            for cell in range(size):
                w = rank[rot(cell ^ entry, -(axis + 1))]
                inner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                odd = w if w % 2 else w - 1  # trailing ones of it give the axis left along
                turn = 0 if w == 0 else ((odd ^ (odd + 1)).bit_length() - 1) % dims
                at = (entry * dims + axis) * size + cell
                digits[at] = w
                nexts[at] = (entry ^ rot(inner, axis + 1)) * dims + (axis + turn + 1) % dims
    return digits, nexts


def hilbert_index(cells: list[str], bits: int) -> Column:
    """Curve index of integer columns with ``bits`` bits each, as one SQL expression."""
    dims = len(cells)
    digits, nexts = hilbert_tables(dims)
    cell = " + ".join(f"(shiftright({c}, l) & 1) * {1 << i}" for i, c in enumerate(cells))
    at = f"a.s * {1 << dims} + {cell}"
    listed = [f"array({', '.join(map(str, t))})" for t in (digits, nexts)]
    return F.expr(
        f"aggregate(sequence({bits - 1}, 0, -1), named_struct('s', 0, 'k', 0L), (a, l) -> "
        f"named_struct('s', get({listed[1]}, {at}), 'k', a.k * {1 << dims} + get({listed[0]}, {at})), a -> a.k)")


def ordinal(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with the string ``col`` as a number that keeps its order: the rows with lesser
    values, from prefix sums over the distinct values (null stays null)."""
    values = rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    ranks = stage(prefix_sums(values, [col], {"rank": "n"}, "values").select(col, "rank"), "ranks")
    return rows.join(ranks, col, "left").drop(col).withColumnRenamed("rank", col)


def shard(docs: DataFrame, shards: int = 40, law: str = "rows", bits: int = 5, id_col: str = "doc_id",
          text_col: str = "text", keys: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, curve, law, shard, slot, grown_shard.

    ``law`` "rows": shards' counts differ by one at most; "bytes": a row belongs to the
    shard that holds its middle byte, so sizes are equal within one row.  The order is
    curve index, then crc32 of the text, then doc_id: copies stand together and a value
    that a third of the rows share is still cut evenly.  Null text has size 16 and crc of
    the empty text; null metadata takes cell 0; null ids sort first; repeated rows each get
    a slot; an empty table gives no rows.  A missing key column counts as null.  Other
    columns are not read.

    Text is read once, into one small row per document, staged; only those small rows are
    joined and sorted, with the staged row's number last, so a row that is repeated very often
    is dealt to many tasks.  Strings are quantised by their rank among all rows.  Window partitions are the sort's ranges, and the per-range
    totals that turn places into ranks are one row per task."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = [F.col(k).cast("string") if k in docs.columns else F.lit(None).cast("string") for k in keys]
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                       *[c.alias(f"d{i}") for i, c in enumerate(found)])
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "shard-rows")
    for i in range(len(keys)):
        rows = ordinal(rows, f"d{i}")
    dims = [f"d{i}" for i in range(len(keys))] + ["size"]
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*[F.percentile_approx(d, steps, 1000).alias(d) for d in dims]).first()
    cells = []
    for i, d in enumerate(dims):
        bounds = sorted(set(cuts[d] or []))  # at most 2**bits - 1 numbers
        code = F.lit(len(bounds))
        for n, b in reversed(list(enumerate(bounds))):
            code = F.when(F.col(d) <= b, n).otherwise(code)
        rows = rows.withColumn(f"c{i}", F.coalesce(F.when(F.col(d).isNotNull(), code), F.lit(0)))
        cells.append(f"c{i}")
    order = ["curve", "text_crc32", "doc_id", "size", "row"]
    placed = stage(rows.select("doc_id", "size", "text_crc32", "row", hilbert_index(cells, bits).alias("curve")), "curve")
    n = partitions(docs.sparkSession)
    ranged = stage(placed.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    whole = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    every = Window.partitionBy()
    base = (ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
            .select("range", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("rows_before"),
                    F.coalesce(F.sum("b").over(whole), F.lit(0)).alias("bytes_before"),
                    F.sum("n").over(every).alias("all_rows"), F.sum("b").over(every).alias("all_bytes")))
    within = Window.partitionBy("range").orderBy(*order)
    ranked = (ranged.withColumn("place", F.row_number().over(within) - 1)
              .withColumn("bytes", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
              .join(F.broadcast(base), "range")  # as many rows as tasks
              .withColumn("rank", F.col("rows_before") + F.col("place")))
    if law == "rows":
        out = (ranked.withColumn("shard", F.expr(f"cast(rank * {shards} div all_rows as int)"))
               .withColumn("slot", F.expr(f"rank - (shard * all_rows + {shards - 1}) div {shards}")))
    elif law == "bytes":
        middle = "(bytes_before + bytes) * 2 - size"
        ranked = stage(ranked.withColumn("shard", F.expr(f"cast(({middle}) * {shards} div (2 * all_bytes) as int)")),
                       "ranked")
        first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))
        out = ranked.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first"))
    else:
        raise ValueError(f"law must be rows or bytes, not {law}")
    return out.select("doc_id", "size", "text_crc32", "curve", F.lit(law).alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
