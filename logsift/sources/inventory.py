"""File inventory and folder browsing (SRC5), and the audit of a scan (A7, SRC6).
``binaryFile`` without the ``content`` column lists files with size and modification
time and reads no bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import parent_dir, percent
from logsift.session import _fs

TRAILER_BYTES = 256 << 20  # gzip files up to this size have their trailer checked


def _plain(path):
    """A path of ``binaryFile`` in the form ``file_path`` has."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``file_path, length, modified`` of every file under ``path`` whose name fits ``glob``
    (files of no bytes at all are not listed by Spark's sources)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(path).select(_plain("path").alias("file_path"), "length", F.col("modificationTime").alias("modified")))


def browse(spark: SparkSession, path: str) -> DataFrame:
    """Entries directly in folder ``path``: ``name, path, is_dir, size, gz_count``.
    Files give their size; sub-folders, empty ones too, give the number of ``.gz`` files
    directly in them.  The folder itself is listed by the driver, its sub-folders by Spark's
    file source.  A missing path or a file raises, as the reference reports an error."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        raise FileNotFoundError(f"Cannot access: {path}")
    if not fs.getFileStatus(hpath).isDirectory():
        raise NotADirectoryError("Not a directory")
    found = [(e.getPath().getName(), e.getPath().toString(), e.isDirectory(), 0 if e.isDirectory() else e.getLen())
             for e in fs.listStatus(hpath)]
    root = path.rstrip("/")
    entries = spark.createDataFrame([(n, f"{root}/{n}", d, size) for n, _, d, size in found],
                                    "name string, path string, is_dir boolean, size long")
    folders = [full for _, full, is_dir, _ in found if is_dir]
    if not folders:
        return entries.withColumn("gz_count", F.lit(0))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
             .load(folders).select(parent_dir(_plain("path")).alias("folder")))
    direct = spark.createDataFrame([(n, full) for n, full, d, _ in found if d], "name string, folder string") \
        .withColumn("folder", _plain("folder"))
    counts = files.join(direct, "folder").groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("gz_count"))
    return (entries.join(counts, "name", "left")
            .select("name", "path", "is_dir", "size", F.coalesce("gz_count", F.lit(0)).alias("gz_count")))


def scan_audit(spark: SparkSession, path: str, lines: DataFrame, trailer_bytes: int = TRAILER_BYTES) -> DataFrame:
    """What a search of the gzip logs under ``path`` really read: ``file_path, length, lines,
    status, reason`` of every file of the inventory.

    ``lines``: the numbered lines that were read (``read_gz_lines``).  ``status`` is ``read``,
    ``cut`` (some lines, then a break), ``empty`` or ``unreadable``.  A gzip file ends with the
    size of its text, so a file whose lines have fewer bytes than that was cut; text whose
    lines lost a carriage return or their last newline may be up to that much shorter.  A file larger
    than ``trailer_bytes`` is taken to be whole if it gave lines."""
    listed = file_inventory(spark, path, "*.gz").select("file_path", "length")
    got = lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    content = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz")
               .load(path).where(F.col("length").between(1, trailer_bytes)))
    tail = F.hex(F.expr("substring(content, -4, 4)"))
    order = F.concat(*[F.substring(tail, i, 2) for i in (7, 5, 3, 1)])  # little endian
    ends = content.select(_plain("path").alias("file_path"), (F.hex(F.expr("substring(content, 1, 2)")) == "1F8B").alias("gzip"),
                          F.conv(order, 16, 10).cast("long").alias("text_bytes"))
    n = F.coalesce("lines", F.lit(0))
    short = F.col("text_bytes") - F.pmod(F.col("bytes"), F.lit(1 << 32))
    blank = F.col("gzip") & (F.col("text_bytes") == 0)
    status = (F.when(n == 0, F.when(blank, "empty").otherwise("unreadable"))
              .when(F.col("gzip") & ((short > F.col("lines")) | (short < -1)), "cut").otherwise("read"))
    reason = (F.when(F.col("status") == "read", F.lit(None).cast("string"))
              .when(F.col("status") == "empty", "no lines")
              .when(F.col("status") == "cut", "ends before the size in its trailer")
              .when(~F.coalesce("gzip", F.lit(True)), "not gzip").otherwise("no line before the break"))
    return (listed.join(got, "file_path", "left").join(ends, "file_path", "left")
            .withColumn("status", status).select("file_path", "length", n.alias("lines"), "status", reason.alias("reason")))


def scan_totals(audit: DataFrame, matches: DataFrame) -> DataFrame:
    """A7 of gzip logs: ``files_total, files_searched, lines_scanned, matches_found, percent,
    searched_size`` with the files' real bytes; files that gave nothing readable are not
    among the searched ones, so the percent can be below 100."""
    searched = F.col("status").isin("read", "cut", "empty")
    totals = audit.agg(F.count(F.lit(1)).alias("files_total"), F.count_if(searched).alias("files_searched"),
                       F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_scanned"),
                       F.coalesce(F.sum(F.when(searched, F.col("length"))), F.lit(0)).alias("searched_size"))
    found = matches.agg(F.count(F.lit(1)).alias("matches_found"))
    return totals.join(F.broadcast(found), F.lit(True)).select(  # one row each
        "files_total", "files_searched", "lines_scanned", "matches_found",
        percent(F.col("files_searched"), F.col("files_total")).alias("percent"), "searched_size")
