"""Mixing sources to target weights (operator 11), by weighted sampling without replacement.

Every document draws an exponential key divided by its quality weight; a source's documents
in order of their keys are such a sample at every length.  A source's budget is filled with
complete epochs of all its documents first, and the rest with the first documents of that
order, found by prefix sums.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.llm.common import partitions, stage

WORD = r"[^\x20\x09-\x0D]+"
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_WEIGHT = 0.05


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def quality_weight(text: Column) -> Column:
    """Share of letters among a text's characters, 0.05 at least: tables, markup and digits
    are drawn later than prose.  1 for an empty text."""
    letters = F.length(F.regexp_replace(text, NOT_LETTERS, "")).cast("double")
    return F.when(text == "", F.lit(1.0)).otherwise(F.greatest(letters / F.length(text), F.lit(LEAST_WEIGHT)))


def prefix_sums(rows: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``rows`` with, for each entry of ``sums`` (new column: summed column), that column's
    total over all rows before the row in ``order``, whose columns tell rows apart.

    The rows are sorted in ranges, so no task holds more than its share; the ranges' totals
    that turn local sums into whole ones are one row per task."""
    ranged = stage(rows.repartitionByRange(partitions(rows.sparkSession), *order)
                   .withColumn("__range", F.spark_partition_id()), name)
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = (ranged.groupBy("__range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
            .select("__range", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"__{k}") for k in sums]))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(base), "__range")  # as many rows as tasks
    return (out.withColumns({k: F.sum(c).over(within) - F.col(c) + F.col(f"__{k}") for k, c in sums.items()})
            .drop("__range", *[f"__{k}" for k in sums]))


def budgets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``sizes`` (place: sources in order, source_size) with target, quota (whole words of
    it), epochs (complete passes) and rest (words of the last, partial one).

    Sources share the sum of all sizes by their weights, dealt out in order and repeating.
    A target ends at ``repeats`` times the source's size and the excess is shared again by
    weight until none is above: with sources ordered by cap / weight, one is capped exactly
    if its cap is below its share of what the caps before it leave.  Sums of integers."""
    once = math.lcm(*weights)
    dealt = prefix_sums(sizes.withColumn("one", F.lit(1).cast("long")), ["place"], {"nth": "one"}, "sources")
    weigh = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weigh = F.when(F.col("nth") % len(weights) == i, w).otherwise(weigh)
    dealt = (dealt.withColumn("weight", weigh.cast("long"))
             .withColumn("cap", F.col("source_size") * repeats)
             .withColumn("ratio", F.col("cap") * F.expr(f"{once} div weight")))
    run = stage(prefix_sums(dealt, ["ratio", "place"], {"caps": "cap", "weights": "weight"}, "caps"), "capped")
    whole = run.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all"))
    one = whole.first()
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  products of sums outgrow a long
    left = F.lit(one["words"]).cast("long") - F.col("caps")
    open_weight = F.lit(one["all"]).cast("long") - F.col("weights")
    run = run.withColumn("full", wide(F.col("cap")) * wide(open_weight) < wide(left) * wide(F.col("weight")))
    two = run.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0)).alias("cap"),
                  F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)).alias("weight")).first()
    shared, weight = one["words"] - two["cap"], max(two["weight"], 1)
    part = F.col("weight") * F.lit(shared).cast("long")
    return (run.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double"))
                           .otherwise(part.cast("double") / F.lit(float(weight))))
            .withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"weight * {shared}L div {weight}L")))
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
            .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
            .select("place", "source_size", "weight", "target", "quota", "epochs", "rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, weight: Column | None = None,
        split_last: bool = True, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source_size, target, taken (words the mix takes, repeats
    counted), epochs (whole copies taken), weight (of quality), key of every row.

    ``weight``: quality weight of a row, above 0 (default: ``quality_weight``).  With
    ``split_last`` the document at the end of a source's budget gives its first words up to
    it, so taken sums to the target's whole words; without, it is taken whole if at least
    half of it is within.  The draw is a hash of id and text, so reruns agree.

    A null text has no words and takes none; a null source is a source of its own, the last;
    a null id counts as an empty one in the hash; repeated rows are drawn with equal keys,
    one after another, and each gets a row; empty sources have target 0; an empty table gives no
    rows.  Other columns are not read.

    Text is read once; one small row per document is staged and sorted in ranges over source
    and key, with the staged row's number last, so neither a hot source nor a row that is
    repeated very often lies in one task."""
    text = _text(text_col)
    sum_ = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text)))
    draw = (F.conv(F.substring(sum_, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("place"),  # null last
        (quality_weight(text) if weight is None else weight).cast("double").alias("weight"),
        draw.alias("draw"), sum_.alias("sum")).withColumn("key", -F.log("draw") / F.col("weight"))
    rows = stage(rows.drop("draw").withColumn("row", F.monotonically_increasing_id()), "drawn")
    plan = stage(budgets(rows.groupBy("place").agg(F.sum("size").alias("source_size")), weights, repeats), "budgets")

    order = ["place", "key", "sum", "row"]
    ranged = stage(rows.repartitionByRange(partitions(docs.sparkSession), *order)
                   .withColumn("range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = (ranged.groupBy("range", "place").agg(F.sum("size").alias("words"))  # a source: one row per task at most
            .withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
            .join(plan.drop("weight"), "place"))
    within = Window.partitionBy("range", "place").orderBy("key", "sum", "row").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - (F.col("before") + F.sum("size").over(within) - F.col("size"))  # words left for this one
    out = ranged.join(runs, ["range", "place"]).withColumn("room", room)
    if split_last:
        last = F.greatest(F.least(F.col("room"), F.col("size")), F.lit(0))
    else:
        last = F.when((F.col("room") > 0) & (2 * F.col("room") >= F.col("size")), F.col("size")).otherwise(F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
                      "epochs", "weight", "key")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(regexp_replace(coalesce(text, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS letters,
         length(coalesce(text, '')) AS chars,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS sum
  FROM documents
), k AS (
  SELECT *, -ln((CAST(CAST('0x' || substr(sum, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
              / CASE WHEN chars = 0 THEN 1.0 ELSE greatest(CAST(letters AS DOUBLE) / chars, 0.05) END AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM k GROUP BY source
), w AS (SELECT *, CAST(1 + (nth - 1) % 3 AS HUGEINT) AS weight, 3 * source_size AS cap FROM s),
c AS (
  SELECT *, sum(source_size) OVER () - (sum(cap) OVER o - cap) AS left_over,
         sum(weight) OVER () - (sum(weight) OVER o - weight) AS open_weight
  FROM w WINDOW o AS (ORDER BY cap * (6 // weight), nth)
), f AS (SELECT *, cap * open_weight < left_over * weight AS capped FROM c),
t AS (
  SELECT sum(source_size) - coalesce(sum(cap) FILTER (WHERE capped), 0) AS shared,
         greatest(coalesce(sum(weight) FILTER (WHERE NOT capped), 0), 1) AS weight FROM f
), b AS (
  SELECT f.source, f.source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
           ELSE CAST(f.weight * shared AS DOUBLE) / CAST(t.weight AS DOUBLE) END AS target,
         CASE WHEN capped THEN cap ELSE f.weight * shared // t.weight END AS quota
  FROM f, t
), p AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, quota,
         CASE WHEN b.source_size > 0 THEN quota // b.source_size ELSE 0 END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.sum, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(least(quota - epochs * source_size - before, size), 0) AS BIGINT) AS taken
FROM p
"""
