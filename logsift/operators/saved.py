"""Saved searches applied to lines (J7) and deleting one (U4).

A short list is compiled to predicates (path, case-insensitive keywords, AND/OR), and
one scan of the lines evaluates them all: a line yields one row per saved search it
matches -- no join, no pairs.  A list longer than ``CHUNK`` is a table: each keyword is
found by one of its q-grams and its search's path, joined to the lines' q-grams and folders
in one scan and then verified.  Grams are as long as keywords allow (up to 8 code points), so
many similar keywords are told apart before a line meets them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.keyfilter import KeyFilter, small_side
from logsift.operators.predicates import keyword_hits, path_filter
from logsift.schemas import SAVED_SEARCH, SavedSearch

CHUNK = 256  # saved searches that are compiled to predicates
GRAMS = (8, 3, 2, 1)  # code points of a q-gram: a keyword has the longest that fits in it


def saved_table(spark: SparkSession, searches: list[SavedSearch]) -> DataFrame:
    return spark.createDataFrame(
        [(s.id, s.name, list(s.keywords), s.mode, s.path, s.created_at) for s in searches],
        SAVED_SEARCH)


def _predicate(row, lower):
    keywords = row["keywords"] or []
    if any(not (k or "").strip() for k in keywords):
        raise ValueError("empty keyword")  # as a search refuses it; it would match every line
    hits = keyword_hits(keywords, lower)
    if not hits:
        return None
    cond = reduce(lambda a, b: a & b, hits) if row["mode"] == "AND" else reduce(lambda a, b: a | b, hits)
    p = path_filter(row["path"] or "")
    return cond if p is None else (p & cond)


def apply_saved(lines: DataFrame, saved: DataFrame) -> DataFrame:
    """``search_id, file_path, line_number, line`` for every (saved search, line)
    match."""
    rows = saved.select("id", "keywords", "mode", "path").limit(CHUNK + 1).collect()
    if len(rows) > CHUNK:
        return apply_many(lines, saved)
    lower = F.lower(F.col("line"))
    empty = F.array().cast("array<string>")
    preds = [(r["id"], _predicate(r, lower)) for r in rows]
    tags = [F.when(pred, F.array(F.lit(i))).otherwise(empty) for i, pred in preds if pred is not None]
    if not tags:
        return lines.sparkSession.createDataFrame(
            [], "search_id string, file_path string, line_number long, line string")
    return (lines.select("file_path", "line_number", "line", F.explode(F.concat(*tags)).alias("search_id"))
            .select("search_id", "file_path", "line_number", "line"))


def _grams(lines: DataFrame, sizes: list[int]) -> DataFrame:
    """Every run of so many code points of each line: ``at``, ``size`` and ``key``, the run in
    UTF-32, whose signs are found without reading the line up to them."""
    wide = lines.select("file_path", "line_number", "line", F.encode(_low(), "UTF-32").alias("wide"))
    signs = F.floor(F.octet_length("wide") / 4).cast("int")
    places = wide.where(signs > 0).select("*", F.explode(F.sequence(F.lit(1), signs)).alias("at"))
    runs = places.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).where(F.col("at") + F.col("size") <= signs + 1)
    return runs.select("file_path", "line_number", "line", "at",
                       F.substring("wide", 4 * F.col("at") - 3, 4 * F.col("size")).alias("key"))


def _low():
    return F.make_valid_utf8(F.lower("line"))


def search_grams(saved: DataFrame) -> DataFrame:
    """The q-grams that find saved searches: ``gram, id, keywords, first``, path and scope.  An AND
    search is found by its longest keyword (``first`` null), an OR search by each of its
    keywords (``first``: its place).  Of a keyword's q-grams the one that fewest searches share
    is taken, so a common beginning of many keywords finds none of them."""
    searches = saved.select("id", "mode", F.coalesce("path", F.lit("")).alias("path"),
                            F.array_distinct(F.transform("keywords", F.lower)).alias("keywords")) \
        .where(F.size("keywords") > 0)
    all_of = F.coalesce(F.col("mode") == "AND", F.lit(False))
    longest = F.array_max(F.transform("keywords", lambda k: F.struct(F.length(k).alias("n"), k.alias("keyword"))))
    found_by = searches.where(all_of).select("*", F.lit(None).cast("int").alias("first"), longest["keyword"].alias("keyword")) \
        .unionByName(searches.where(~all_of).select("*", F.posexplode("keywords").alias("first", "keyword")))
    size = F.coalesce(*[F.when(F.length("keyword") >= n, F.lit(n)) for n in GRAMS])
    places = F.sequence(F.lit(1), F.length("keyword") - size + 1)
    grams = found_by.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).select(
        "keyword", "n", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring("keyword", i, size)))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.sum("n").alias("shared"))
    rarest = grams.join(shared, "gram").groupBy("keyword").agg(F.min(F.struct("shared", "gram"))["gram"].alias("gram"))
    return found_by.join(rarest, "keyword").select("gram", "id", "keywords", "first", "path", _scope().alias("scope"))


def _plain():
    return F.regexp_replace("file_path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def _bare():
    return F.regexp_replace(F.regexp_replace("path", "/+$", ""), "^file:/*", "file:/")


def _in_path():
    """``path_filter`` with the path of a row."""
    p = _bare()
    where = F.when(F.startswith(p, F.lit("/")), _plain()).otherwise(F.col("file_path"))
    return (F.col("path") == "") | (where == p) | F.startswith(where, F.concat(p, F.lit("/")))


def _scope():
    """What a search's path is among ``_scopes`` of the files in it: ``/`` for the root, empty
    without a path."""
    return F.when(F.col("path") == "", F.lit("")).when(_bare() == "", F.lit("/")).otherwise(_bare())


def _scopes():
    """Every scope a line lies in: its file and all folders above, by name and by plain path."""
    def above(path):
        names = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))

    names = F.transform(above(F.coalesce("file_path", F.lit(""))), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    return F.array_distinct(F.concat(F.array(F.lit("")), names, above(F.coalesce(_plain(), F.lit("")))))


def apply_many(lines: DataFrame, saved: DataFrame) -> DataFrame:
    """``apply_saved`` for any number of searches in one scan of the lines.

    A line's q-grams are joined to the searches' (broadcast below a measured size), of those
    bound to a path only where the line lies in it.  Bounded filters drop all other grams and
    paths first, so what is joined, and shuffled if the searches are too many to broadcast, is
    in proportion to the matches.  What meets is verified on the line, where its gram is first;
    an OR search counts only by its first keyword that the line holds.  So each match comes
    once and nothing is shuffled to make it so."""
    blank = F.exists("keywords", lambda k: k.isNull() | k.rlike(r"(?U)^\s*$"))
    if not saved.where(blank).isEmpty():
        raise ValueError("empty keyword")
    found_by = small_side(search_grams(saved).withColumn("key", F.encode("gram", "UTF-32")), "saved-grams")
    sizes = sorted(r[0] for r in found_by.select(F.length("gram")).distinct().collect())  # of GRAMS
    if not sizes:
        return lines.sparkSession.createDataFrame(
            [], "search_id string, file_path string, line_number long, line string")
    met = KeyFilter(found_by, ["key"]).keep(_grams(lines, sizes), ["key"])
    met = KeyFilter(found_by, ["key", "scope"]).keep(met.select("*", F.explode(_scopes()).alias("scope")), ["key", "scope"])
    met = met.join(found_by, ["key", "scope"]).where(F.instr(_low(), F.col("gram")) == F.col("at"))  # where it is first

    def holds(k):
        return F.contains(F.lower("line"), k)

    hit = F.when(F.col("first").isNull(), F.forall("keywords", holds)).otherwise(
        holds(F.col("keywords")[F.col("first")]) & ~F.exists(F.slice("keywords", F.lit(1), F.col("first")), holds))
    return met.where(_in_path() & hit).select(F.col("id").alias("search_id"), "file_path", "line_number", "line")


def delete_saved(saved: DataFrame, search_id: str) -> DataFrame:
    """U4: the saved list without ``search_id``."""
    return saved.where(F.col("id") != F.lit(search_id))
