"""Reading stored match records (SRC7): one JSON object per line, malformed
lines skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsift.schemas import MATCH


def read_match_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCH).option("mode", "DROPMALFORMED").json(path)
