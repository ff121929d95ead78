"""A token index kept fresh file by file (J4, J5, SNK7).

The index of a folder of gzip logs is a Parquet table partitioned by file bucket (a hash of
``file_path``).  Beside its keywords each file has one row without keyword that tells the
size and time it was indexed with, so what is indexed and its keywords change together.
``refresh_index`` compares those rows with the files that are there, reads the new and
changed ones only, and rewrites only the buckets they or deleted files lie in (dynamic
partition overwrite).  A refresh that is stopped half-way leaves whole buckets behind; the
next one finds the rest still stale and mends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.candidates import among, listed
from logsift.operators.keyfilter import small_side
from logsift.operators.tokens import file_keywords
from logsift.session import materialize, path_exists
from logsift.sources.gzlogs import raw_gz_lines
from logsift.sources.inventory import file_inventory

BUCKETS = 256
SCHEMA = "file_path string, keyword string, length long, modified timestamp, bucket int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")


def _table(root: str, buckets: int) -> str:
    return f"{root.rstrip('/')}/of-{buckets}"


def _stored(spark: SparkSession, root: str, buckets: int) -> DataFrame:
    path = _table(root, buckets)
    if not path_exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def read_index(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    """``file_path, keyword`` of all indexed files."""
    return _stored(spark, root, buckets).where(F.col("keyword").isNotNull()).select("file_path", "keyword")


def indexed_files(spark: SparkSession, root: str, buckets: int = BUCKETS) -> DataFrame:
    """``file_path, length, modified`` of every indexed file, as it was then."""
    rows = _stored(spark, root, buckets)
    return rows.where(F.col("keyword").isNull() & F.col("file_path").isNotNull()).select("file_path", "length", "modified")


def file_changes(inventory: DataFrame, indexed: DataFrame) -> DataFrame:
    """``file_path, status, length, modified`` of files that are ``new``, ``changed`` (another
    size or time than when indexed) or ``deleted``."""
    then = indexed.select("file_path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    status = (F.when(F.col("_length").isNull(), "new").when(F.col("length").isNull(), "deleted")
              .when((F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified")), "changed"))
    return (inventory.join(then, "file_path", "full_outer").withColumn("status", status)
            .where(F.col("status").isNotNull()).select("file_path", "status", "length", "modified"))


def _changed_lines(spark: SparkSession, logs: str, files: DataFrame, touched: list[int], buckets: int) -> DataFrame:
    """Lines of ``files`` only.  A short list is a predicate on the file's name; a long one
    opens the files of the touched buckets, and the join drops those that did not change."""
    staged, paths = listed(files)
    lines = raw_gz_lines(spark, logs)
    if paths is not None:
        return lines.where(among(paths))
    return lines.where(_bucket(buckets).isin(touched)).join(staged, "file_path", "left_semi")


def refresh_index(spark: SparkSession, logs: str, root: str, buckets: int = BUCKETS) -> DataFrame:
    """Bring the index under ``root`` up to date with the gzip logs under ``logs``.  Gives the
    changes that were found (``file_changes``); none means that nothing was read or written."""
    found = file_changes(file_inventory(spark, logs, "*.gz"), indexed_files(spark, root, buckets))
    changes = materialize(found.withColumn("bucket", _bucket(buckets)), "index-changes")
    touched = sorted(r["bucket"] for r in changes.select("bucket").distinct().collect())  # at most ``buckets``
    if touched:
        now = changes.where(F.col("status") != "deleted")
        lines = _changed_lines(spark, logs, now.select("file_path"), touched, buckets)
        nothing = {"length": F.lit(None).cast("long"), "modified": F.lit(None).cast("timestamp")}
        no_word = F.lit(None).cast("string")
        words = file_keywords(lines).withColumns(nothing).withColumn("bucket", _bucket(buckets))
        files = now.withColumn("keyword", no_word)
        # one row without file per bucket, so that a bucket whose last file went is rewritten too
        marks = (changes.select("bucket").distinct().withColumn("file_path", no_word)
                 .withColumn("keyword", no_word).withColumns(nothing))
        kept = (_stored(spark, root, buckets).where(F.col("bucket").isin(touched) & F.col("file_path").isNotNull())
                .join(small_side(changes.select("file_path"), "index-changed"), "file_path", "left_anti"))
        columns = ["file_path", "keyword", "length", "modified", "bucket"]
        rows = kept.select(columns)
        for part in (words, files, marks):
            rows = rows.unionByName(part.select(columns))
        # a large bucket is split by keyword over tasks; each file of the table is sorted by keyword
        (rows.repartitionByRange("bucket", "keyword").sortWithinPartitions("bucket", "keyword", "file_path")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("parquet.bloom.filter.enabled#keyword", "true").partitionBy("bucket").parquet(_table(root, buckets)))
    return changes.drop("bucket")
