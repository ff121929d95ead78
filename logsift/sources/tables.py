"""Log-line views of the supplied tables, and the one-time ingest.

``events`` is rendered as log lines in the pipe-separated format the reference
parses, one gz-like file per hour (``yyyy/MM/dd/HH/app.log.gz``); ``documents``
becomes one file per document (``source/doc_id``) with one row per text line.

Ingest writes ``log_lines`` once as Parquet, partitioned by day (``dt``) and sorted
by ``file_path, line_number`` inside each file, so later searches prune days by
partition and hours / line ranges by row-group statistics, and never renumber."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.numbering import number_rows
from logsift.session import delete_path, path_exists, path_state, work_dir
from logsift.sources.hours import day_of

INGEST_VERSION = "1"
PART_BYTES = 8 << 20  # text of one task where tasks hold what they read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts_of(df: DataFrame, text: str) -> int:
    """Parts of about PART_BYTES of a text column, the session's partitions at least."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))


def event_line(c=F.col) -> Column:
    """The log line for one event row."""
    level = F.when(c("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))
    bank = (F.when(c("user_id") % 4 == 0, F.lit("SBI"))
            .when(c("user_id") % 4 == 1, F.lit("HDFC"))
            .when(c("user_id") % 4 == 2, F.lit("FINO"))
            .otherwise(F.lit("AXIS")))
    code = (F.when(c("event_id") % 3 == 0, F.lit("TIMEOUT"))
            .when(c("event_id") % 3 == 1, F.lit("SERVER_ERROR"))
            .otherwise(F.lit("AUTH_FAIL")))
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | "), level,
        F.lit(" | USER:USR"), c("user_id").cast("string"),
        F.lit(" | API:/"), c("event_type"),
        F.lit(" | AMOUNT:"), c("value").cast("decimal(12,2)").cast("string"),
        F.lit(" | BANK:"), bank,
        F.when(c("event_type") == "error", F.concat(F.lit(" | ERROR_CODE:"), code))
         .otherwise(F.lit("")))


def event_file(ts: Column | None = None) -> Column:
    ts = F.col("ts") if ts is None else ts
    return F.concat(F.date_format(ts, "yyyy/MM/dd/HH"), F.lit("/app.log.gz"))


def events_unnumbered(events: DataFrame) -> DataFrame:
    """``event_id, ts, file_path, line`` -- lines before numbering (also the
    streaming form, where line numbers are not available)."""
    return events.select("event_id", "ts", event_file().alias("file_path"),
                         event_line().alias("line"))


def documents_as_lines(documents: DataFrame) -> DataFrame:
    """``file_path, line_number, line`` for the documents table: split on ``\\n``,
    one trailing ``\\r`` dropped, blank lines kept.  Positions come from the
    split, so no shuffle is needed."""
    return (documents
            .select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
                    F.posexplode(F.split(F.col("text"), "\n")).alias("_pos", "_raw"))
            .select("file_path",
                    (F.col("_pos") + 1).cast("long").alias("line_number"),
                    F.regexp_replace("_raw", r"\r\z", "").alias("line")))


def _source_key(spark: SparkSession, path: str) -> str:
    """Key of what is derived from a source: its state, and the time zone its lines show."""
    state = f"{path}|{path_state(spark, path)}|{spark.conf.get('spark.sql.session.timeZone')}"
    return hashlib.sha1(f"{state}|{INGEST_VERSION}".encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    """A finished table: Spark writes ``_SUCCESS`` last."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def ingest_event_lines(spark: SparkSession, sf_dir: str, out_path: str | None = None) -> str:
    """Write ``log_lines`` for the events table once; return its path.

    Numbering uses the skew-safe ``number_rows`` (range-partitioned, no task
    holds a whole hot file).  The result is reused while the source is unchanged."""
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    out_path = out_path or f"{work_dir(spark)}/tables/event_lines-{_source_key(spark, src)}"
    if _exists(spark, out_path):
        return out_path
    unnumbered = events_unnumbered(spark.read.parquet(src))
    staging = out_path.rstrip("/") + "-staging"
    numbered = number_rows(unnumbered, ["ts", "event_id"], ["file_path"], staging=staging)
    (numbered
     .select("file_path", "line_number", "line",
             day_of("file_path").alias("dt"))
     .sortWithinPartitions("dt", "file_path", "line_number")
     .write.mode("overwrite").partitionBy("dt").parquet(out_path))
    delete_path(spark, staging)
    return out_path


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested ``log_lines`` of the events table (``file_path, line_number,
    line, dt``)."""
    return spark.read.parquet(ingest_event_lines(spark, sf_dir))


# Lines of one document stay together in chunks of this many lines.
DOC_CHUNK_LINES = 10_000


def ingest_document_lines(spark: SparkSession, sf_dir: str, out_path: str | None = None) -> str:
    """Write the documents' ``log_lines`` once, sorted by ``file_path,
    line_number`` inside each file, so later scans get one task per output file
    (the source may be a few large row groups).

    Rows are hash-partitioned on ``(file_path, line_number div DOC_CHUNK_LINES)``:
    a document's lines stay together chunk by chunk (per-file aggregations still
    combine map-side), a huge document is spread over many tasks, and unlike a
    range partitioning no sampling pass over the source is needed.  A partition, sorted in
    one task, has about PART_BYTES of text however large the table is."""
    src = f"{sf_dir.rstrip('/')}/documents.parquet"
    out_path = out_path or f"{work_dir(spark)}/tables/document_lines-{_source_key(spark, src)}"
    if _exists(spark, out_path):
        return out_path
    documents = spark.read.parquet(src)
    (documents_as_lines(documents)
     .repartition(parts_of(documents, "text"), "file_path", F.floor(F.col("line_number") / DOC_CHUNK_LINES))
     .sortWithinPartitions("file_path", "line_number")
     .write.mode("overwrite").parquet(out_path))
    return out_path


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingested ``log_lines`` of the documents table."""
    return spark.read.parquet(ingest_document_lines(spark, sf_dir))
