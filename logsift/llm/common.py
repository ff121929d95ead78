"""Helpers shared by the corpus operators: reading tables, staging tables in the
shared folder, and Arrow batches cut by bytes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder (in folders ``by`` a column) and read it back.

    The rows outlive a lost executor and are computed once.  The folder is
    deleted when the Spark application ends."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session's settings ``conf`` for the plans made and run within."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the cluster was sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


FAN_IN = 64  # rows of fixed size that one task merges


def merged(parts: DataFrame, fold: Callable[[pa.Table], dict[str, pa.Array]], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of fixed size, one per task (and value of ``by``), folded FAN_IN at a time in two
    rounds, so that no task holds more than FAN_IN of them and 100,000 tasks leave 25.  Rows
    are folded in the order of their tasks: reruns give the same sums to the last bit."""
    names = [c for c in parts.columns if c not in by]
    parts = parts.withColumn("slot", F.spark_partition_id())
    shape = parts.schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("slot")
        got = fold(t.select(names)) | {"slot": t.column("group").slice(0, 1)}
        return pa.table({c: got[c] if c in got else t.column(c).slice(0, 1) for c in shape.names})

    for _ in range(2):
        parts = parts.withColumn("group", F.expr(f"cast(slot div {FAN_IN} as int)")).groupBy(*by, "group") \
            .applyInArrow(run, shape)
    return parts.drop("slot")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col, "") if col.null_count else col
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str | tuple[str, ...], max_bytes: int,
             done: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of text (in one or several columns)
    each, one row at least.  At the task's end, ``done`` is called and free memory returned."""
    columns = (text,) if isinstance(text, str) else text
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                        for c in columns)
            part = np.cumsum(sizes) // max_bytes
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                yield batch.slice(a, b - a)
    finally:
        if done:
            done()
        release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: Spark reuses its Python workers, and what one
    stage's largest batch took would be kept through all later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def crc_mod(col: str, mod: int):
    """crc32 of an id's decimal text, modulo ``mod`` (the held-out folds)."""
    return F.crc32(F.col(col).cast("string")) % mod
