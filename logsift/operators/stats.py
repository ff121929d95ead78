"""Match statistics (A1-A6), top-k per dimension (W4, SL5), in one pass.

Every match becomes a list of ``(dim, label)`` facts -- one per ``KEY:value`` part
of the line, one for its hour, one per matched term -- exploded and counted with
a partial + final hash aggregate (a hot label is combined map-side).  Top-k uses
``row_number() <= k`` per dimension, which Spark turns into a partial
WindowGroupLimit before the shuffle, so no task sees more than k rows per
dimension from each partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.text import trim_space

from logsift.fixed import HOUR_LEN, HOUR_MIN_LINE, HOUR_START, PART_DIMS, TOP_K  # noqa: E402
DIMS = [d for _, d in PART_DIMS] + ["timeline", "matched_terms"]


# Tags for the facts that are not line parts.  They start with "|", which no
# part of a line split on "|" can contain.
_HOUR_TAG, _TERM_TAG = "|H|", "|T|"


def match_facts(matches: DataFrame, text_col: str = "line_text",
                terms_col: str = "matched_terms") -> DataFrame:
    """``dim, label`` rows for every counted fact of every match.

    One ``explode`` over the line's parts plus tagged hour and term entries,
    then a CASE on each row -- plain expressions that stay in whole-stage
    codegen."""
    text = F.col(text_col)
    hour = F.when(F.length(text) >= HOUR_MIN_LINE,
                  F.array(F.concat(F.lit(_HOUR_TAG), F.substring(text, HOUR_START, HOUR_LEN),
                                   F.lit(":00")))) \
        .otherwise(F.array().cast("array<string>"))
    terms = F.transform(F.coalesce(F.col(terms_col), F.array().cast("array<string>")),
                        lambda t: F.concat(F.lit(_TERM_TAG), t))
    p = F.col("_p")
    tp = trim_space(p)
    dim, label = None, None
    for prefix, name in [(_HOUR_TAG, "timeline"), (_TERM_TAG, "matched_terms")]:
        cond = p.startswith(prefix)
        dim = F.when(cond, F.lit(name)) if dim is None else dim.when(cond, F.lit(name))
        label = F.when(cond, F.substring(p, len(prefix) + 1, 1 << 30)) if label is None \
            else label.when(cond, F.substring(p, len(prefix) + 1, 1 << 30))
    for prefix, name in PART_DIMS:
        cond = tp.startswith(prefix)
        dim = dim.when(cond, F.lit(name))
        label = label.when(cond, F.substring(tp, len(prefix) + 1, 1 << 30))
    return (matches.select(F.explode(F.concat(F.split(text, r"\|"), hour, terms)).alias("_p"))
            .select(dim.alias("dim"), label.alias("label"))
            .where(F.col("dim").isNotNull())
            .where((F.col("dim") != "timeline")
                   | F.col("label").rlike(r"^([01][0-9]|2[0-3]):00$")))


def fact_counts(matches: DataFrame, **kw) -> DataFrame:
    """``dim, label, cnt`` over all matches."""
    return match_facts(matches, **kw).groupBy("dim", "label").agg(F.count(F.lit(1)).alias("cnt"))


def top_facts(matches: DataFrame, dims: list[str] | None = None, **kw) -> DataFrame:
    """``dim, label, cnt, rk``: top 10 per line-part dimension, top 20 matched terms
    (count descending, label ascending on ties) and every hour of the timeline
    in hour order."""
    counts = fact_counts(matches, **kw)
    if dims is not None:
        counts = counts.where(F.col("dim").isin(dims))
    order_key = F.when(F.col("dim") == "timeline", F.lit(0)).otherwise(-F.col("cnt"))
    w = Window.partitionBy("dim").orderBy(order_key, F.col("label"))
    limit = F.lit(10)
    for dim, k in TOP_K.items():
        if k != 10:
            limit = F.when(F.col("dim") == dim, F.lit(k)).otherwise(limit)
    return (counts.withColumn("rk", F.row_number().over(w).cast("long"))
            .where(F.col("rk") <= max(TOP_K.values()))
            .where(F.col("rk") <= limit))


def dimension(matches: DataFrame, dim: str, **kw) -> DataFrame:
    """One stats list (``label, cnt, rk``)."""
    return top_facts(matches, [dim], **kw).select("label", "cnt", "rk")
