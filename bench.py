"""Benchmark: ingest the events and documents tables once, then time the
headline queries on them at $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS].  Each query is executed fully with the no-op sink (no
collect), twice: ``cold`` is the first run (includes code generation and class
loading for that plan shape), ``queries`` the second, steady-state run.  Ingest
is timed once, cold.  ``value`` sums ingest and the steady-state query times.
Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logsift.plans.queries import QUERIES  # noqa: E402
from logsift.session import build_session, work_dir  # noqa: E402
from logsift.sources.tables import (  # noqa: E402
    document_lines, event_lines, ingest_document_lines, ingest_event_lines)

HEADLINE = ["search_or", "search_and", "search_regex", "search_docs", "time_of_day", "context_join",
            "context_window", "stats_topk", "search_totals", "max_matches", "inverted_index",
            "files_and", "bloom_build", "prune_candidates", "minute_index", "saved_search_apply", "page",
            "report_rows", "gz_search"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", app="logsift-bench")
    # the work folder is new for every session, so ingest is measured, not reused
    work_dir(spark)
    # untimed: the first job of a JVM pays class loading, not ingest
    spark.range(100_000).selectExpr("sum(id)", "count(distinct id % 7)").collect()
    times: dict[str, float] = {}
    t0 = time.time()
    ingest_event_lines(spark, sf_dir)
    times["ingest"] = round(time.time() - t0, 3)
    t0 = time.time()
    ingest_document_lines(spark, sf_dir)
    times["ingest_documents"] = round(time.time() - t0, 3)
    n_lines = event_lines(spark, sf_dir).count()
    n_doc_lines = document_lines(spark, sf_dir).count()
    cold: dict[str, float] = {}
    for name in HEADLINE:
        for attempt in range(2):
            t = time.time()
            run(QUERIES[name](spark, sf_dir))
            (cold if attempt == 0 else times)[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "total_sec", "value": total, "unit": "sec", "queries": times, "cold": cold,
        "cold_total": round(sum(cold.values()) + times["ingest"] + times["ingest_documents"], 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus), "event_lines": n_lines, "document_lines": n_doc_lines,
        "event_lines_per_sec_search_or": round(n_lines / max(times["search_or"], 1e-9)),
    }))


if __name__ == "__main__":
    main()
