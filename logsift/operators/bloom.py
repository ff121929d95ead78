"""Per-file bloom filters (A9) and probes (A10), as data.

Sizing follows the standard formulas for n = 10,000 items at 1 % false
positives: m = ceil(-n ln p / ln(2)^2) bits, k = ceil(m/n ln 2) hashes.  Bit
positions use double hashing, ``(h1 + i*h2) mod m``, with h1/h2 the first two
32-bit words of the token's MD5 -- a built-in function every engine has, so the
filter can be checked outside Spark.

A filter is a bitmap in 64-bit words, one row per word that has a set bit
(``file_path, word, bits``): at most 1,498 rows a file however large it is, few for a
small one.  Stored in order of ``word``, a probe of one keyword reads the rows of its
k words only, of all files at once, and tests one bit in each."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import explode_fields

from logsift.fixed import BLOOM_FPR, BLOOM_ITEMS  # noqa: E402

BLOOM_BITS = math.ceil(-BLOOM_ITEMS * math.log(BLOOM_FPR) / math.log(2) ** 2)
BLOOM_HASHES = math.ceil(BLOOM_BITS / BLOOM_ITEMS * math.log(2))


def _word(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")


def hash_words(token: Column) -> tuple[Column, Column]:
    """h1, h2: the first two 32-bit words of the token's MD5."""
    h = F.md5(token)
    return _word(h, 0), _word(h, 1)


def positions_from(h1: Column, h2: Column) -> Column:
    """``array<bigint>`` of the k bit positions (k plain expressions, no lambda,
    so it compiles into the stage's generated code)."""
    return F.array(*[F.pmod(h1 + F.lit(i) * h2, F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)])


def bit_positions(token: Column) -> Column:
    """``array<bigint>`` of the k bit positions of a token."""
    return positions_from(*hash_words(token))


def build_blooms(lines: DataFrame) -> DataFrame:
    """``file_path, bits`` -- every lower-cased whitespace token of the file
    (no punctuation strip).  Tokens are deduplicated before hashing."""
    toks = (explode_fields(lines, "line", ["file_path"], "_t")
            .select("file_path", F.lower("_t").alias("token")).distinct())
    # hash once per token in a projection; the explode then only does arithmetic
    h1, h2 = hash_words(F.col("token"))
    hashed = toks.select("file_path", h1.alias("_h1"), h2.alias("_h2"))
    bits = hashed.select("file_path", F.explode(positions_from(F.col("_h1"), F.col("_h2"))).alias("bit"))
    word = F.shiftright("bit", 6).cast("int").alias("word")
    # words are merged map-side in a hash aggregate
    return (bits.select("file_path", word, F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("_one"))
            .groupBy("file_path", "word").agg(F.bit_or("_one").alias("bits")))


def write_blooms(blooms: DataFrame, path: str, partitions: int | None = None) -> str:
    """Store the bitmaps in order of word and file, so that a probe's words are few row groups."""
    n = partitions or int(blooms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (blooms.repartitionByRange(n, "word", "file_path").sortWithinPartitions("word", "file_path")
     .write.mode("overwrite").parquet(path))
    return path


def positions_of(spark: SparkSession, keywords) -> list[list[int]]:
    """The bit positions of each keyword, lower-cased, from the same expressions as the build."""
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keywords)], "i int, k string")
    found = rows.select("i", bit_positions(F.lower("k")).alias("p")).collect()
    return [sorted(set(r["p"])) for r in sorted(found, key=lambda r: r["i"])]


def probe(blooms: DataFrame, keywords, mode: str = "OR") -> DataFrame:
    """A10: ``file_path`` of the files that may hold every keyword (AND) or at least one of
    them (any other mode).  The words' numbers reach the scan; a file's hits are counted."""
    keys = positions_of(blooms.sparkSession, keywords)
    words = sorted({p >> 6 for of in keys for p in of})

    def bit(p: int) -> Column:
        return F.max(F.when(F.col("word") == p >> 6, F.shiftright("bits", p & 63).bitwiseAND(F.lit(1)))
                     .otherwise(F.lit(0))) == 1

    found = [reduce(lambda a, b: a & b, [bit(p) for p in of]) for of in keys]
    join = (lambda a, b: a & b) if mode == "AND" else (lambda a, b: a | b)
    return (blooms.where(F.col("word").isin(words)).groupBy("file_path").agg(reduce(join, found).alias("_may"))
            .where("_may").select("file_path"))
