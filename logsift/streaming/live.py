"""Searching files as they land (ST1) and live totals (ST2) with Structured
Streaming.

ST1 is stateless: each micro-batch of new lines is filtered by the search
predicate and appended to a Parquet sink; the checkpoint makes the sink
exactly-once and lets a restarted query continue where it stopped.  Line numbers
need a whole file, so the plain stream gives ``file_path, line``; for gz folders
``search_gz_stream`` numbers inside ``foreachBatch`` (a gz file always arrives
whole in one micro-batch).

ST2 keeps per-file running counts in the state store (a streaming aggregation)
and writes the changed ones each batch; totals are a small aggregate over that table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.numbering import number_contiguous, number_rows
from logsift.operators.predicates import line_match, matched_terms
from logsift.schemas import SearchSpec
from logsift.session import delete_path, materialize, work_dir
from logsift.sources.gzlogs import gz_columns
from logsift.sources.tables import _source_key, events_unnumbered


def _stream_root(spark: SparkSession, kind: str, sf_dir: str, spec: SearchSpec) -> str:
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    key = hashlib.sha1(f"{_source_key(spark, src)}|{spec.canonical_json()}".encode()).hexdigest()[:16]
    return f"{work_dir(spark)}/streams/{kind}-{key}"


def event_line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming ``file_path, line`` of the events table (one Parquet file per
    micro-batch)."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))
    return events_unnumbered(events).select("file_path", "line")


def search_stream(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """ST1: ``file_path, line_text, matched_terms`` of a streaming line source."""
    spec = spec.normalized()
    return (lines.where(line_match(spec, F.col("line")))
            .select("file_path", F.col("line").alias("line_text"),
                    F.concat_ws("|", matched_terms(spec, F.col("line"))).alias("matched_terms")))


def run_to_sink(stream: DataFrame, root: str) -> str:
    """Run a stream over everything available now into ``root/data``."""
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start(f"{root}/data"))
    q.awaitTermination()
    return f"{root}/data"


def stream_search_events(spark: SparkSession, sf_dir: str, spec: SearchSpec) -> DataFrame:
    root = _stream_root(spark, "search", sf_dir, spec)
    path = run_to_sink(search_stream(event_line_stream(spark, sf_dir), spec), root)
    return spark.read.parquet(path)


def stream_search_events_numbered(spark: SparkSession, sf_dir: str, spec: SearchSpec) -> DataFrame:
    """ST1 with line numbers on the events stream, however its log files are spread over
    source files.  Each micro-batch adds its lines to a lines table; the log files that it
    touched are numbered anew from all their lines so far (skew-safe ``number_rows``) and
    their matches written under the batch's id.  A file's rows are those of its last batch."""
    spec = spec.normalized()
    root = _stream_root(spark, "search-numbered", sf_dir, spec)
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(src).schema
    events = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{sf_dir.rstrip('/')}/events*.parquet"))
    out, files, seen = (f"{root}/{name}" for name in ("data", "files", "lines"))

    def write(batch: DataFrame, batch_id: int) -> None:
        events_unnumbered(batch).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
        spark.read.parquet(f"{seen}/batch={batch_id}").select("file_path").distinct() \
            .write.mode("overwrite").parquet(f"{files}/batch={batch_id}")
        touched = spark.read.parquet(f"{files}/batch={batch_id}")
        so_far = spark.read.parquet(seen).where(F.col("batch") <= batch_id).drop("batch")
        staging = f"{root}/numbered-{batch_id}"
        numbered = number_rows(so_far.join(touched, "file_path", "left_semi"), ["ts", "event_id"], ["file_path"],
                               staging=staging)
        (numbered.where(line_match(spec, F.col("line")))
         .select("file_path", "line_number", F.col("line").alias("line_text"),
                 F.concat_ws("|", matched_terms(spec, F.col("line"))).alias("matched_terms"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
        delete_path(spark, staging)

    q = (events.writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = spark.read.parquet(files).groupBy("file_path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(out).join(last, ["file_path", "batch"], "left_semi").drop("batch")


def file_counts_stream(lines: DataFrame, spec: SearchSpec) -> DataFrame:
    """ST2 state: per file, lines scanned and matches found so far."""
    spec = spec.normalized()
    return lines.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("lines_scanned"),
        F.count_if(line_match(spec, F.col("line"))).alias("matches_found"))


def run_state_table(stream: DataFrame, root: str) -> str:
    """Write each batch's changed files (update mode) under its id; ``totals_of`` takes a
    file's last state, so readers never meet a half-written table."""
    out = f"{root}/state"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def totals_of(file_counts: DataFrame) -> DataFrame:
    if "batch" in file_counts.columns:
        file_counts = file_counts.groupBy("file_path").agg(
            F.max(F.struct("batch", "lines_scanned", "matches_found")).alias("s")).select("file_path", "s.*")
    return file_counts.agg(F.count(F.lit(1)).alias("files_total"),
                           F.sum("lines_scanned").cast("long").alias("lines_scanned"),
                           F.sum("matches_found").cast("long").alias("matches_found"))


def stream_totals_events(spark: SparkSession, sf_dir: str, spec: SearchSpec) -> DataFrame:
    root = _stream_root(spark, "totals", sf_dir, spec)
    path = run_state_table(file_counts_stream(event_line_stream(spark, sf_dir), spec), root)
    return totals_of(spark.read.parquet(path))


def search_gz_stream(spark: SparkSession, source_glob: str, spec: SearchSpec, root: str,
                     max_files_per_trigger: int = 100) -> str:
    """ST1 for gz logs with line numbers: each micro-batch holds whole files, so
    lines are numbered inside ``foreachBatch`` and each batch's matches written to
    ``root/data/batch=<id>`` (overwritten on a replay, so exactly once).  As in the batch
    reader, a file that is not gzip gives no rows and a cut one its readable lines; neither
    ends the stream."""
    spec = spec.normalized()
    work_dir(spark)
    raw = gz_columns(spark.readStream.option("lineSep", "\n").option("ignoreCorruptFiles", "true")
                     .option("maxFilesPerTrigger", max_files_per_trigger).text(source_glob))
    out = f"{root}/data"

    def write(batch: DataFrame, batch_id: int) -> None:
        staging = f"{root}/tagged-{batch_id}"
        tagged = materialize(batch.withColumn("_pos", F.monotonically_increasing_id()), "stream-batch", staging)
        numbered = number_contiguous(tagged, "file_path", "_pos")
        (numbered.where(line_match(spec, F.col("line")))
         .select("file_path", "line_number", F.col("line").alias("line_text"),
                 matched_terms(spec, F.col("line")).alias("matched_terms"))
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))
        delete_path(spark, staging)

    q = (raw.writeStream.foreachBatch(write)
         .option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out
