"""Searching log files that grow (ST1): line numbers and context over micro-batches.

New lines of a file come after all its earlier ones.  Each micro-batch is numbered on its own
(skew-safe, one shuffle) and moved on by the file's lines so far, so every line is read once.
What a file hands on is one small row: its number of lines and its last 2C lines, of which
the context of the next matches is made.  A keyed state operator would bring a file's rows
of a batch into one task without their order; here a hot file is spread over tasks.

State and matches are written under the batch's id from those of earlier batches only, so a
batch that is run again writes the same rows.  A match in a file's last C lines lacks some of
its context; it is written at once, and again by the batch that brings the missing lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.fixed import MAX_CONTEXT
from logsift.operators.keyfilter import small_side
from logsift.operators.numbering import number_rows
from logsift.operators.search import search
from logsift.schemas import SearchSpec
from logsift.session import delete_path, materialize, path_exists

STATE = "file_path string, n_lines long, tail array<string>, batch long"
SNAPSHOT_EVERY = 20  # batches after which the state of all files is written again


def _state(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """``file_path, n_lines, tail`` of every file, as it is before batch ``batch_id``."""
    if batch_id == 0 or not path_exists(spark, f"{root}/state"):
        return spark.createDataFrame([], STATE).drop("batch")
    since = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    rows = spark.read.schema(STATE).parquet(f"{root}/state").where(F.col("batch").between(since, batch_id - 1))
    return rows.groupBy("file_path").agg(F.max_by(F.struct("n_lines", "tail"), "batch").alias("s")).select("file_path", "s.*")


def write_batch(batch: DataFrame, batch_id: int, spec: SearchSpec, order_cols: list[str], root: str) -> None:
    """Number and search one micro-batch (``file_path, line`` and the order columns)."""
    spark = batch.sparkSession
    context = min(max(spec.context_lines, 0), MAX_CONTEXT)
    staging = f"{root}/staging-{batch_id}"
    new = number_rows(batch, order_cols, ["file_path"], staging=f"{staging}/numbered")
    before = _state(spark, root, batch_id)
    touched = small_side(batch.select("file_path").distinct(), "stream-files")
    earlier = materialize(before.join(touched, "file_path", "left_semi"), "stream-state", f"{staging}/earlier")
    counts = small_side(earlier.select("file_path", "n_lines"), "stream-counts")
    offset = F.coalesce("n_lines", F.lit(0))
    moved = new.join(counts, "file_path", "left").select(
        "file_path", (F.col("line_number") + offset).alias("line_number"), "line", offset.alias("seen"))
    tails = earlier.select("file_path", "n_lines", F.size("tail").alias("n"), F.posexplode("tail").alias("i", "line")).select(
        "file_path", (F.col("n_lines") - F.col("n") + F.col("i") + 1).alias("line_number"), "line", F.col("n_lines").alias("seen"))
    lines = materialize(moved.unionByName(tails), "stream-lines", f"{staging}/lines")

    matches = search(lines, spec).join(counts, "file_path", "left").where(F.col("line_number") > offset - context)
    matches.drop("n_lines").write.mode("overwrite").parquet(f"{root}/data/batch={batch_id}")

    ends = small_side(lines.groupBy("file_path").agg(F.max("line_number").alias("n_lines")), "stream-ends")
    last = (lines.join(ends, "file_path").where(F.col("line_number") > F.col("n_lines") - 2 * context)
            .groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("t")))
    state = ends.join(last, "file_path", "left").select(
        "file_path", "n_lines", F.coalesce(F.col("t.line"), F.array().cast("array<string>")).alias("tail"))
    if batch_id % SNAPSHOT_EVERY == 0:
        state = state.unionByName(before.join(touched, "file_path", "left_anti"))
    state.write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")
    delete_path(spark, staging)


def search_growing(stream: DataFrame, spec: SearchSpec, order_cols: list[str], root: str) -> str:
    """Search all lines that a stream of ``file_path, line`` and ``order_cols`` has now; run again
    when more have come.  Line windows count from a file's first line; ``max_matches`` is refused."""
    spec = spec.normalized()
    if spec.max_matches:
        raise ValueError("max_matches needs all lines")
    q = (stream.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, spec, order_cols, root))
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return root


def growing_matches(spark: SparkSession, root: str) -> DataFrame:
    """The matches so far, each as its last batch wrote it."""
    rows = spark.read.parquet(f"{root}/data")
    fields = [c for c in rows.columns if c not in ("file_path", "line_number", "batch")]
    return (rows.groupBy("file_path", "line_number").agg(F.max_by(F.struct(*fields), "batch").alias("m"))
            .select("file_path", "line_number", "m.*"))
