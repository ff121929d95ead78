"""Totals of each micro-batch while a search runs (ST2): metrics that Spark observes in the
search's own scan, handed to a streaming listener."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logsift.operators.predicates import line_match
from logsift.schemas import SearchSpec
from logsift.streaming.live import search_stream

METRIC = "search_progress"
TOTALS = "batch long, lines_scanned long, matches_found long"


class BatchTotals(StreamingQueryListener):
    """``(batch, lines_scanned, matches_found)`` of every micro-batch of the query named ``name``."""

    def __init__(self, name: str):
        self.name, self.rows, self.done = name, {}, threading.Event()
        self._id = None

    def onQueryStarted(self, event):
        if event.name == self.name:
            self._id = event.runId

    def onQueryProgress(self, event):
        p = event.progress
        if p.runId == self._id and METRIC in p.observedMetrics:
            m = p.observedMetrics[METRIC]
            self.rows[p.batchId] = (m["lines_scanned"], m["matches_found"])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self._id:
            self.done.set()


def search_with_progress(stream: DataFrame, spec: SearchSpec, root: str, name: str, wait: float = 60.0) -> DataFrame:
    """ST1 into ``root/data`` with ST2 beside it, in one scan: gives ``batch, lines_scanned,
    matches_found`` of every batch so far (``root/totals``).  Totals are written after a run; those of
    a run whose driver was lost are not told, its matches are whole."""
    spec = spec.normalized()
    spark = stream.sparkSession
    seen = stream.observe(METRIC, F.count(F.lit(1)).alias("lines_scanned"),
                          F.count_if(line_match(spec, F.col("line"))).alias("matches_found"))
    totals = BatchTotals(name)
    spark.streams.addListener(totals)
    try:
        q = (search_stream(seen, spec).writeStream.format("parquet").outputMode("append").queryName(name)
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/data"))
        q.awaitTermination()
        totals.done.wait(wait)  # events come in order, the last one after all progress
    finally:
        spark.streams.removeListener(totals)
    rows = [(i, *t) for i, t in sorted(totals.rows.items())]
    spark.createDataFrame(rows, TOTALS).coalesce(1).write.mode("append").parquet(f"{root}/totals")
    return spark.read.schema(TOTALS).parquet(f"{root}/totals")
