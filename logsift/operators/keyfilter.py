"""Joining a large table with a small one, by measured sizes.

``small_side`` stages a side that should be small, measures it and broadcasts it only below
a bound; beyond it the join is left to Spark.  ``KeyFilter`` drops the rows of a large
table whose key none of another table's rows can have, before they are shuffled.  The
filter has a bounded size whatever it is built from: one bit per hashed key in 64-bit
words, of which only those with a set bit are kept.  It lets some rows through by chance
and never drops one that is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.session import materialize

BROADCAST_BYTES = 32 << 20  # of a staged side, in memory, that is broadcast
FILTER_BITS = 27  # a filter has 2**27 bits: 2**21 words (16 bytes each) at most


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows of a staged table: its strings and binaries, arrays as JSON text, 8 for
    any other value."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        text = isinstance(f.dataType, (T.StringType, T.BinaryType))
        value = F.to_json(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) if text else None
        width = width + (F.lit(8) if value is None else F.coalesce(F.octet_length(value), F.lit(0)) + 16)
    return df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]


def small_side(df: DataFrame, name: str, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` staged, and marked for broadcast if it measures ``bound`` bytes or fewer."""
    staged = materialize(df, name)
    return F.broadcast(staged) if measured_bytes(staged) <= bound else staged


def _word(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits + 6)


def _bit(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits).bitwiseAND(F.lit(63)).cast("int")


class KeyFilter:
    """Filter over the keys of ``keys`` (columns or expressions of it)."""

    def __init__(self, keys: DataFrame, key: list[Column | str], bits: int = FILTER_BITS):
        self.bits = bits
        hashed = F.xxhash64(*key)
        self.words = (keys.select(_word(hashed, bits).alias("_word"), _bit(hashed, bits).alias("_bit"))
                      .groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")))

    def keep(self, rows: DataFrame, key: list[Column | str]) -> DataFrame:
        """The rows whose key may be among the filter's; no shuffle of the rows."""
        hashed = F.xxhash64(*key)
        hit = rows.withColumn("_word", _word(hashed, self.bits)).withColumn("_bit", _bit(hashed, self.bits)) \
            .join(F.broadcast(self.words), "_word")  # 2**(bits - 6) rows at most
        return hit.where("shiftright(_bits, _bit) & 1L = 1").select(*rows.columns)
