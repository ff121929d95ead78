"""Reading gzip log folders (SRC1, SRC2, SRC3, SRC6) and ingesting them.

A gz file is not splittable, so Spark reads each in one task, in order.  Line
numbers therefore need no shuffle: rows are tagged with
``monotonically_increasing_id`` (consecutive inside a task), written once to the
shared work folder so the tags are fixed, and ``tag - min(tag of the file) + 1`` is the line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.numbering import number_contiguous
from logsift.schemas import LOG_LINES
from logsift.session import _fs, delete_path, materialize


def raw_gz_lines(spark: SparkSession, path: str, ignore_corrupt: bool = True) -> DataFrame:
    """``file_path, line`` for every ``.gz`` under ``path`` (or the one file),
    unnumbered.  Split on ``\\n`` only; one trailing ``\\r`` is dropped; a file that
    is not gzip is skipped and a truncated one keeps its readable lines.

    ``path`` is one of any file system Spark reads; ``file_path`` is the qualified path with
    blanks and other signs as they are in the name."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(path)
    reader = (spark.read.option("lineSep", "\n")
              .option("ignoreCorruptFiles", "true" if ignore_corrupt else "false"))
    if fs.getFileStatus(hpath).isDirectory():
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz")
        if not _has_gz(fs, hpath):
            return spark.createDataFrame([], "file_path string, line string")
    elif not path.endswith(".gz"):
        raise ValueError("File must be .gz")
    return gz_columns(reader.text(path))


def gz_columns(text: DataFrame) -> DataFrame:
    """``file_path, line`` of a text scan (or stream): the decoded, qualified path, and the line
    without one trailing ``\r``."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(decoded, "^file:/+", "file:/")
    return text.select(plain.alias("file_path"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def _has_gz(fs, root) -> bool:
    """Lists until the first gzip file."""
    files = fs.listFiles(root, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if name.endswith(".gz") and not name.startswith((".", "_")):
            return True
    return False


def read_gz_lines(spark: SparkSession, path: str, file_filter: Column | None = None,
                  ignore_corrupt: bool = True, staging: str | None = None) -> DataFrame:
    """``file_path, line_number, line`` of a gz folder.  ``file_filter`` (a
    predicate on ``file_path``) is applied before numbering, so Spark prunes the
    files it rejects instead of opening them."""
    raw = raw_gz_lines(spark, path, ignore_corrupt)
    if file_filter is not None:
        raw = raw.where(file_filter)
    tagged = materialize(raw.withColumn("_pos", F.monotonically_increasing_id()), "gz-lines", staging)
    return number_contiguous(tagged, "file_path", "_pos").select(
        *[f.name for f in LOG_LINES.fields])


def read_gz_roots(spark: SparkSession, paths: list[str], file_filter: Column | None = None) -> DataFrame:
    """The lines of several roots as one DataFrame (union all)."""
    from functools import reduce
    return reduce(DataFrame.unionByName, [read_gz_lines(spark, p, file_filter) for p in paths])


def ingest_gz(spark: SparkSession, path: str, out_path: str,
              file_filter: Column | None = None) -> str:
    """Write a gz folder as a ``log_lines`` Parquet table, sorted by file and
    line inside each output file."""
    staging = out_path.rstrip("/") + "-staging"
    (read_gz_lines(spark, path, file_filter, staging=staging)
     .sortWithinPartitions("file_path", "line_number")
     .write.mode("overwrite").parquet(out_path))
    delete_path(spark, staging)
    return out_path
