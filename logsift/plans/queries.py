"""The registered queries: one per operator of the inventory, each over the
whole supplied tables.  ``events`` is read through the ingested ``log_lines``
table (written once per source version); ``documents`` through its line view.

Array columns are rendered as strings (``|``- or newline-joined) so results can
be compared with the SQL checks value by value."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.engine import LogEngine
from logsift.functions.text import line_timestamp, match_from_json, match_to_json
from logsift.operators import bloom, candidates, indexstore, minutes, saved, stats, tokens
from logsift.operators.context import context_window
from logsift.operators.predicates import line_match
from logsift.operators.search import lines_read, search, search_totals
from logsift.plans import params as P
from logsift.schemas import SearchSpec
from logsift.session import _fs, delete_path, materialize, path_state, qualified, work_dir
from logsift.sinks import results
from logsift.sources.hours import hour_folder_filter
from logsift.sources.inventory import browse, scan_audit, scan_totals
from logsift.sources.tables import _exists, _source_key, document_lines, event_lines, events_unnumbered, table
from logsift.streaming import growing, live, progress


def _flat(matches: DataFrame) -> DataFrame:
    return matches.select("file_path", "line_number", "line_text",
                          F.concat_ws("|", "matched_terms").alias("matched_terms"))


def _search(spec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(search(event_lines(spark, sf_dir), spec))
    return run


def _search_docs(spec):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(search(document_lines(spark, sf_dir), spec))
    return run


def context_join_q(spark, sf_dir):
    m = search(event_lines(spark, sf_dir), P.CONTEXT)  # context_lines > 0: J1 attached
    return m.select("file_path", "line_number", "context_start",
                    F.array_join("context_lines", "\n").alias("context"))


def context_window_q(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    w = context_window(lines_read(lines, P.CONTEXT), P.CONTEXT.context_lines)
    return (w.where(line_match(P.CONTEXT, F.col("line")))
            .select("file_path", "line_number", "context_start",
                    F.array_join("context_lines", "\n").alias("context")))


def _stats_matches(spark, sf_dir):
    return search(event_lines(spark, sf_dir), P.STATS)


def _dim(dim):
    def run(spark, sf_dir):
        return stats.dimension(_stats_matches(spark, sf_dir), dim)
    return run


def stats_topk_q(spark, sf_dir):
    return stats.top_facts(_stats_matches(spark, sf_dir))


def search_totals_q(spark, sf_dir):
    return search_totals(event_lines(spark, sf_dir), P.TOTALS)


def page_q(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    root = f"{work_dir(spark)}/results"
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    key = results.store_results(lines, P.PAGED, root, f"{src}|{path_state(spark, src)}")
    page = results.page_of(results.stored_matches(spark, root, key), P.PAGE, P.PAGE_SIZE)
    return page.select("file_path", "line_number", "line_text",
                       F.concat_ws("|", "matched_terms").alias("matched_terms"), "result_no")


def page_repeat_q(spark, sf_dir):
    """SL3 of a search that was run before: its key comes from a file listing, its rows
    from the stored result."""
    eng = LogEngine(spark, event_lines(spark, sf_dir), f"{work_dir(spark)}/engine-pages",
                    source=f"{sf_dir.rstrip('/')}/events.parquet")
    eng.run(P.PAGED)
    page, _ = eng.page(P.PAGED, P.PAGE, P.PAGE_SIZE)
    return page.select("file_path", "line_number", "line_text",
                       F.concat_ws("|", "matched_terms").alias("matched_terms"), "result_no")


def hour_folders_q(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return (lines.where(hour_folder_filter(*P.HOURS, dt=F.col("dt")))
            .groupBy("file_path").agg(F.count(F.lit(1)).alias("n_lines")))


def inverted_index_q(spark, sf_dir):
    lines = document_lines(spark, sf_dir)
    return tokens.file_keywords(lines, tokens.index_parts(lines))


def _write_index(lines: DataFrame, path: str) -> str:
    parts = tokens.index_parts(lines)
    return tokens.write_index(tokens.file_keywords(lines, parts), path, parts)


def _stored(spark, sf_dir, source: str, name: str, write) -> DataFrame:
    """An index table, written once per state of its source and then only read."""
    src = f"{sf_dir.rstrip('/')}/{source}.parquet"
    path = f"{work_dir(spark)}/indexes/{name}-{_source_key(spark, src)}"
    if not _exists(spark, path):
        write(path)
    return spark.read.parquet(path)


def document_index(spark, sf_dir) -> DataFrame:
    """SNK7: the documents' token index."""
    return _stored(spark, sf_dir, "documents", "document-tokens", lambda path: _write_index(
        document_lines(spark, sf_dir), path))


def event_index(spark, sf_dir) -> DataFrame:
    """SNK7: the event files' token index."""
    return _stored(spark, sf_dir, "events", "event-tokens", lambda path: _write_index(
        event_lines(spark, sf_dir), path))


def event_blooms(spark, sf_dir) -> DataFrame:
    """The event files' bloom filters."""
    return _stored(spark, sf_dir, "events", "event-bloom-words", lambda path: bloom.write_blooms(
        bloom.build_blooms(event_lines(spark, sf_dir)), path))


def files_or_q(spark, sf_dir):
    return tokens.files_for_keywords(document_index(spark, sf_dir), P.FILES_OR, "OR")


def files_and_q(spark, sf_dir):
    return tokens.files_for_keywords(document_index(spark, sf_dir), P.FILES_AND, "AND")


def files_union_q(spark, sf_dir):
    """The OR lookup as a union of per-keyword file lists."""
    return tokens.files_union(document_index(spark, sf_dir), P.FILES_OR)


def files_intersect_q(spark, sf_dir):
    """The AND lookup as an intersection of per-keyword file lists."""
    return tokens.files_intersect(document_index(spark, sf_dir), P.FILES_AND)


def bloom_build_q(spark, sf_dir):
    b = bloom.build_blooms(event_lines(spark, sf_dir))
    words = F.array_sort(F.collect_list(F.struct("word", F.hex("bits").alias("hex"))))
    return b.groupBy("file_path").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_bits"), words.alias("w")).select(
        "file_path", "n_bits",
        F.md5(F.array_join(F.transform("w", lambda x: F.concat_ws(":", x["word"], x["hex"])), ",")).alias("bits_md5"))


def bloom_probe_q(spark, sf_dir):
    return bloom.probe(event_blooms(spark, sf_dir), **P.BLOOM_PROBE)


def prune_candidates_q(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return candidates.candidate_files(lines, index=event_index(spark, sf_dir), blooms=event_blooms(spark, sf_dir),
                                      **P.PRUNE)


def pruned_search_q(spark, sf_dir):
    """The API-server path: prune to candidate files (hours, bloom, token index),
    then a keyword search of those files only."""
    lines = event_lines(spark, sf_dir)
    in_range = lines.where(hour_folder_filter(P.PRUNE["start"], P.PRUNE["end"], dt=F.col("dt")))
    cands = candidates.candidate_files(lines, index=event_index(spark, sf_dir), blooms=event_blooms(spark, sf_dir),
                                       **P.PRUNE)
    spec = SearchSpec(keywords=P.PRUNE["keywords"], mode=P.PRUNE["mode"])
    return _flat(search(candidates.scan_candidates(in_range, cands), spec))


def minute_index_q(spark, sf_dir):
    return minutes.minute_index(event_lines(spark, sf_dir))


def seek_line_q(spark, sf_dir):
    """J6 over a minute index built once (written to the work folder, as an
    index is) and read by both steps of the lookup."""
    lines = event_lines(spark, sf_dir)
    files = lines.select("file_path").distinct()
    index = materialize(minutes.minute_index(lines), "minute-index")
    return minutes.seek_line(index, P.SEEK_TIME, files)


def _monthly_lines(spark, sf_dir):
    """The event lines as one long file per month, numbered in order of hour and line."""
    from logsift.operators.numbering import number_rows
    lines = event_lines(spark, sf_dir).select(F.substring("file_path", 1, 7).alias("file_path"),
                                              F.col("file_path").alias("hour"), F.col("line_number").alias("at"), "line")
    return number_rows(lines, ["hour", "at"], ["file_path"]).select("file_path", "line_number", "line")


def seek_line_long_q(spark, sf_dir):
    """J6 on files far longer than the margin, with the entry's own line beside it."""
    index = materialize(minutes.minute_index(_monthly_lines(spark, sf_dir)), "minute-index")
    out = minutes.seek_line(index, P.SEEK_LONG)
    entry = minutes.seek_line(index, P.SEEK_LONG, margin=0).withColumnRenamed("start_line", "entry_line")
    return out.join(entry, "file_path")


def seek_search_q(spark, sf_dir):
    """J6 in a search: long files are searched from their start line on, through the index."""
    lines = materialize(_monthly_lines(spark, sf_dir).repartitionByRange("file_path", "line_number")
                        .sortWithinPartitions("file_path", "line_number"), "monthly-lines")
    index = materialize(minutes.minute_index(lines), "minute-index")
    return _flat(search(minutes.lines_from(lines, index, P.SEEK_LONG), P.SEARCH_AND))


def _index_versions(spark, sf_dir):
    """Index as built at INDEX_BUILT_AT (lines written by then) and the files
    written to since, from the line timestamps."""
    lines = event_lines(spark, sf_dir)
    ts = line_timestamp(F.col("line"))
    built_at = F.lit(P.INDEX_BUILT_AT).cast("timestamp_ntz")
    old = tokens.file_keywords(lines.where(ts <= built_at))
    # one aggregate gives both the inventory and the files the old build covered
    per_file = lines.groupBy("file_path").agg(
        F.max(ts).alias("modified"), F.max(F.when(ts <= built_at, F.lit(1))).alias("_covered"))
    inventory = per_file.select("file_path", "modified")
    built = per_file.where(F.col("_covered") == 1).select("file_path", built_at.alias("built_at"))
    return lines, old, inventory, built


def index_replace_q(spark, sf_dir):
    lines, old, inventory, built = _index_versions(spark, sf_dir)
    # the stale list feeds both the new index and the replacement: compute it once
    stale = materialize(tokens.stale_files(inventory, built).select("file_path"), "stale-files")
    new = tokens.file_keywords(lines.join(stale, "file_path", "left_semi"))
    return tokens.replace_files(old, new, stale)


def stale_files_q(spark, sf_dir):
    _, _, inventory, built = _index_versions(spark, sf_dir)
    return tokens.stale_files(inventory, built)


def saved_apply_q(spark, sf_dir):
    return saved.apply_saved(event_lines(spark, sf_dir), saved.saved_table(spark, P.SAVED)) \
        .select("search_id", "file_path", "line_number")


def saved_delete_q(spark, sf_dir):
    remaining = saved.delete_saved(saved.saved_table(spark, P.SAVED), P.DELETED_SAVED)
    return saved.apply_saved(event_lines(spark, sf_dir), remaining) \
        .select("search_id", "file_path", "line_number")


def stored_records_q(spark, sf_dir):
    """SNK1 record form + SRC7: matches written as NDJSON, read back."""
    from logsift.sources.stored import read_match_records
    lines = event_lines(spark, sf_dir)
    key = results.result_summary(lines, P.EXPORT).collect()[0]["query_key"]
    path = f"{work_dir(spark)}/records/{key}"
    results.write_match_records(search(lines, P.EXPORT), path)
    return _flat(read_match_records(spark, path))


def index_lookup_q(spark, sf_dir):
    """SNK7 + A11: the stored token index, sorted by keyword with a Parquet bloom
    filter, looked up (the IN list reaches the scan)."""
    return tokens.files_for_keywords(document_index(spark, sf_dir), P.FILES_OR, "OR")


def _event_gz_logs(spark, sf_dir) -> str:
    """The events as real hourly gzip log files (written once per source)."""
    from logsift.sources.tables import events_unnumbered, table
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    path = f"{work_dir(spark)}/gzlogs/events-{_source_key(spark, src)}"
    if not _exists(spark, path):
        ev = events_unnumbered(table(spark, sf_dir, "events"))
        results.write_gz_logs(ev, path, ["ts", "event_id"], {
            "y": F.date_format("ts", "yyyy"), "m": F.date_format("ts", "MM"),
            "d": F.date_format("ts", "dd"), "h": F.date_format("ts", "HH")})
    return path


def gz_search_q(spark, sf_dir):
    """SRC1-SRC3, SRC6 on data derived from the tables: the hourly gzip logs are
    read back (split on newlines, numbered per file without a shuffle) and
    searched.  ``file_path`` is mapped back to the hour-file name."""
    from logsift.sources.gzlogs import read_gz_lines
    return _flat(search(_hour_named(read_gz_lines(spark, _event_gz_logs(spark, sf_dir))), P.GZ_SEARCH))


def _hour_named(lines: DataFrame) -> DataFrame:
    hour = F.regexp_extract("file_path", r"y=(\d{4})/m=(\d{2})/d=(\d{2})/h=(\d{2})/", 0)
    return lines.withColumn("file_path", F.concat(
        F.regexp_replace(F.regexp_replace(hour, r"[ymdh]=", ""), "/$", ""), F.lit("/app.log.gz")))


def _gz_day(spark, sf_dir) -> str:
    year, month, day = P.GZ_DAY.split("/")
    return f"{_event_gz_logs(spark, sf_dir)}/y={year}/m={month}/d={day}"


def search_path_gz_q(spark, sf_dir):
    """F9 on gz: the user's plain path of a day folder is the search path."""
    from logsift.sources.gzlogs import read_gz_lines
    lines = read_gz_lines(spark, _event_gz_logs(spark, sf_dir))
    spec = replace(P.GZ_SEARCH, search_path=qualified(spark, _gz_day(spark, sf_dir)))
    return _flat(_hour_named(search(lines, spec)))


def browse_q(spark, sf_dir):
    """SRC5: the entries of a day folder, hour folders with their gz counts."""
    return browse(spark, _gz_day(spark, sf_dir)).select("name", "is_dir", "size", "gz_count")


def gz_roots_q(spark, sf_dir):
    """The lines of several roots (day folders) as one search."""
    from logsift.sources.gzlogs import read_gz_roots
    base = _event_gz_logs(spark, sf_dir)
    roots = ["{}/y={}/m={}/d={}".format(base, *day.split("/")) for day in P.GZ_DAYS]
    return _flat(search(_hour_named(read_gz_roots(spark, roots)), P.GZ_SEARCH))


#: Files beside the logs that a scan can't read whole: name and what it holds ("cut": the
#: first half of a gzip file, "empty": a gzip file of no text).
PLANTED = {"not-gzip.gz": b"plain text, no gzip\n", "nothing.gz": "empty", "cut.gz": "cut"}


def _audited_logs(spark, sf_dir) -> str:
    """The events' hourly gzip logs with the planted files beside them (written once)."""
    import gzip

    from logsift.sources.tables import events_unnumbered, table
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    path = f"{work_dir(spark)}/gzlogs/audited-{_source_key(spark, src)}"
    if not _exists(spark, path):
        ev = events_unnumbered(table(spark, sf_dir, "events"))
        results.write_gz_logs(ev, path, ["ts", "event_id"], {
            "y": F.date_format("ts", "yyyy"), "m": F.date_format("ts", "MM"),
            "d": F.date_format("ts", "dd"), "h": F.date_format("ts", "HH")})
    for name, held in PLANTED.items():
        if held == "empty":
            held = gzip.compress(b"")
        elif held == "cut":
            held = gzip.compress("".join(f"{i * 7919 % 100_003} line {i}\n" for i in range(50_000)).encode())
            held = held[:len(held) // 2]
        fs, hpath = _fs(spark, f"{path}/planted/{name}")
        out = fs.create(hpath, True)
        out.write(bytearray(held))
        out.close()
    return path


def scan_audit_q(spark, sf_dir):
    """A7, SRC6: files of each status and their lines; a cut file's lines depend on where it
    breaks, so they are told only as some."""
    from logsift.sources.gzlogs import read_gz_lines
    path = _audited_logs(spark, sf_dir)
    audit = scan_audit(spark, path, read_gz_lines(spark, path))
    return audit.groupBy("status", "reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.when(F.col("status") != "cut", F.col("lines"))).alias("lines"),
        (F.sum("lines") > 0).alias("some_lines"))


def scan_totals_q(spark, sf_dir):
    """A7 of the same logs: files that could not be searched bring the percent below 100."""
    from logsift.sources.gzlogs import read_gz_lines
    path = _audited_logs(spark, sf_dir)
    lines = materialize(read_gz_lines(spark, path), "audited-lines")
    totals = scan_totals(scan_audit(spark, path, lines), search(lines, P.GZ_SEARCH))
    return totals.select("files_total", "files_searched", "matches_found", "percent",
                         (F.col("searched_size") > 0).alias("bytes_read"))


def _exported(spark, sf_dir, kind: str) -> str:
    """A fresh folder for an export of the numbered EXPORT matches."""
    src = f"{sf_dir.rstrip('/')}/events.parquet"
    return f"{work_dir(spark)}/exports/{kind}-{_source_key(spark, src)}"


def _export_matches(spark, sf_dir):
    return results.numbered_matches(search(event_lines(spark, sf_dir), P.EXPORT), P.EXPORT)


def export_txt_q(spark, sf_dir):
    """SNK3, written and read back."""
    path = _exported(spark, sf_dir, "txt")
    results.write_txt(_export_matches(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line_text")


def export_json_q(spark, sf_dir):
    """SNK4, written and read back."""
    path = _exported(spark, sf_dir, "json")
    results.write_json(_export_matches(spark, sf_dir), path)
    return (spark.read.schema("file string, line_number long, matched_terms array<string>, log_message string").json(path)
            .withColumn("matched_terms", F.concat_ws("|", "matched_terms")))


def export_page_q(spark, sf_dir):
    """SNK6: one page as csv, json and text, each written and read back."""
    page = results.page_of(_export_matches(spark, sf_dir), 1, 10)
    read = {"csv": lambda p: spark.read.options(**results.CSV_OPTIONS).schema("log_message string").csv(p),
            "json": lambda p: spark.read.schema("log_message string").json(p),
            "text": lambda p: spark.read.text(p).withColumnRenamed("value", "log_message")}
    out = None
    for fmt, back in read.items():
        path = _exported(spark, sf_dir, f"page-{fmt}")
        results.write_page(page, fmt, path)
        rows = back(path).select(F.lit(fmt).alias("format"), "log_message")
        out = rows if out is None else out.unionByName(rows)
    return out


def json_records_q(spark, sf_dir):
    """FN13: matches with context encoded as JSON objects and decoded again."""
    m = search(event_lines(spark, sf_dir), P.CONTEXT)
    back = m.select(match_to_json(m).alias("j")).select(match_from_json(F.col("j")).alias("m"), "j")
    return back.select("m.file_path", "m.line_number", "m.context_start",
                       F.array_join("m.matched_terms", "|").alias("matched_terms"),
                       F.array_join("m.context_lines", "\n").alias("context"),
                       F.get_json_object("j", "$.line_text").alias("line_text"))


def export_csv_q(spark, sf_dir):
    return results.export_rows(search(event_lines(spark, sf_dir), P.EXPORT))


def report_q(spark, sf_dir):
    numbered = results.numbered_matches(search(event_lines(spark, sf_dir), P.REPORT), P.REPORT)
    total = numbered.count()
    return results.report_rows(numbered, total, P.REPORT.request_id)


def query_key_q(spark, sf_dir):
    return results.result_summary(event_lines(spark, sf_dir), P.KEYED)


def stream_search_q(spark, sf_dir):
    return live.stream_search_events(spark, sf_dir, P.SEARCH_OR)


def stream_search_numbered_q(spark, sf_dir):
    return live.stream_search_events_numbered(spark, sf_dir, P.SEARCH_AND)


def stream_totals_q(spark, sf_dir):
    return live.stream_totals_events(spark, sf_dir, P.SEARCH_OR)


def _hour_levels() -> dict:
    return {"y": F.date_format("ts", "yyyy"), "m": F.date_format("ts", "MM"),
            "d": F.date_format("ts", "dd"), "h": F.date_format("ts", "HH")}


def _scratch(spark, name: str) -> str:
    """A folder of this run alone, which goes when the application ends."""
    path = f"{work_dir(spark)}/runs/{name}-{uuid.uuid4().hex}"
    fs, hpath = _fs(spark, path)
    fs.deleteOnExit(hpath)
    return path


def index_refresh_q(spark, sf_dir):
    """J4, J5, SNK7 on real files: the hourly gzip logs are indexed as they were at
    INDEX_BUILT_AT; then the open hour's log is replaced, later hours arrive, one day's folder is
    removed, and the index is refreshed."""
    logs, root = _scratch(spark, "growing-logs"), _scratch(spark, "growing-index")
    ev = events_unnumbered(table(spark, sf_dir, "events"))
    built_at = F.lit(P.INDEX_BUILT_AT).cast("timestamp_ntz")
    results.write_gz_logs(ev.where(F.col("ts") <= built_at), f"{logs}/early", ["ts", "event_id"], _hour_levels())
    indexstore.refresh_index(spark, logs, root)
    open_hour = P.INDEX_BUILT_AT[:13] + ":00:00"
    results.write_gz_logs(ev.where(F.col("ts") >= F.lit(open_hour).cast("timestamp_ntz")), f"{logs}/late",
                          ["ts", "event_id"], _hour_levels())
    delete_path(spark, f"{logs}/early/" + "y={}/m={}/d={}/h={}".format(*re.split("[- :]", open_hour)[:4]))
    delete_path(spark, f"{logs}/early/" + "y={}/m={}/d={}".format(*P.GZ_DAY.split("/")))
    indexstore.refresh_index(spark, logs, root)
    return _hour_named(indexstore.read_index(spark, root)).select("file_path", "keyword")


def saved_many_q(spark, sf_dir):
    """J7 with a long list: a saved search for every user's errors and one for every log file."""
    lines = event_lines(spark, sf_dir)
    users = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("u")).distinct()
    blank = F.lit("").alias("name"), F.lit("").alias("created_at")
    searches = users.where(F.col("u").isNotNull()).select(
        F.concat(F.lit("user "), "u").alias("id"), blank[0],
        F.array(F.concat(F.lit("USER:USR"), "u", F.lit(" |")), *map(F.lit, P.MANY_USER)).alias("keywords"),
        F.lit("AND").alias("mode"), F.lit("").alias("path"), blank[1])
    files = lines.select("file_path").distinct().select(
        F.concat(F.lit("file "), "file_path").alias("id"), blank[0], F.array(*map(F.lit, P.MANY_FILE)).alias("keywords"),
        F.lit("OR").alias("mode"), F.col("file_path").alias("path"), blank[1])
    return saved.apply_many(lines, searches.unionByName(files)).select("search_id", "file_path", "line_number")


def stream_context_q(spark, sf_dir):
    """ST1 on files that grow: the events arrive in SEGMENTS parts by time, each searched as it
    comes, with line numbers and context over the parts' borders."""
    src, root = _scratch(spark, "segments"), _scratch(spark, "growing-search")
    ev = table(spark, sf_dir, "events")
    cuts = ev.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")),
                                      [k / P.SEGMENTS for k in range(1, P.SEGMENTS)]).alias("c"))
    parts = events_unnumbered(ev).join(F.broadcast(cuts), F.lit(True))  # one row of cuts
    part = F.size(F.filter("c", lambda c: F.unix_micros(F.col("ts").cast("timestamp")) >= c))
    staged = materialize(parts.withColumn("part", F.coalesce(part, F.lit(0))).drop("c"), "segments")
    for k in range(P.SEGMENTS):
        staged.where(F.col("part") == k).drop("part").write.mode("append").parquet(src)
        growing.search_growing(spark.readStream.schema(staged.drop("part").schema).parquet(src), P.CONTEXT,
                               ["ts", "event_id"], root)
    return growing.growing_matches(spark, root).select(
        "file_path", "line_number", "context_start", F.array_join("context_lines", "\n").alias("context"))


def stream_batch_totals_q(spark, sf_dir):
    """ST2 as observed metrics of the search's own scan, added up over its batches."""
    root = _scratch(spark, "observed")
    totals = progress.search_with_progress(live.event_line_stream(spark, sf_dir), P.SEARCH_OR, root, root)
    return totals.agg(F.sum("lines_scanned").alias("lines_scanned"), F.sum("matches_found").alias("matches_found"))


QUERIES = {
    "search_or": _search(P.SEARCH_OR),
    "search_and": _search(P.SEARCH_AND),
    "search_exclude": _search(P.SEARCH_EXCLUDE),
    "search_regex": _search(P.SEARCH_REGEX),
    "search_regex_case": _search(P.SEARCH_REGEX_CASE),
    "search_docs": _search_docs(P.SEARCH_DOCS),
    "search_docs_regex": _search_docs(P.SEARCH_DOCS_REGEX),
    "time_of_day": _search(P.TIME_OF_DAY),
    "time_range": _search(P.TIME_RANGE),
    "line_range": _search(P.LINE_RANGE),
    "head_lines": _search(P.HEAD_LINES),
    "matched_terms": _search(P.MATCHED_TERMS),
    "context_join": context_join_q,
    "context_window": context_window_q,
    "error_codes": _dim("error_codes"),
    "api_endpoints": _dim("api_endpoints"),
    "banks": _dim("banks"),
    "top_users": _dim("top_users"),
    "timeline": _dim("timeline"),
    "term_counts": _dim("matched_terms"),
    "stats_topk": stats_topk_q,
    "search_totals": search_totals_q,
    "max_matches": _search(P.MAX_MATCHES),
    "order_latest": _search(P.LATEST),
    "page": page_q,
    "page_repeat": page_repeat_q,
    "hour_folders": hour_folders_q,
    "browse": browse_q,
    "search_path_gz": search_path_gz_q,
    "inverted_index": inverted_index_q,
    "files_or": files_or_q,
    "files_and": files_and_q,
    "files_union": files_union_q,
    "files_intersect": files_intersect_q,
    "bloom_build": bloom_build_q,
    "bloom_probe": bloom_probe_q,
    "prune_candidates": prune_candidates_q,
    "pruned_search": pruned_search_q,
    "minute_index": minute_index_q,
    "seek_line": seek_line_q,
    "seek_line_long": seek_line_long_q,
    "seek_search": seek_search_q,
    "index_replace": index_replace_q,
    "stale_files": stale_files_q,
    "index_refresh": index_refresh_q,
    "saved_search_many": saved_many_q,
    "saved_search_apply": saved_apply_q,
    "saved_search_delete": saved_delete_q,
    "export_csv_rows": export_csv_q,
    "gz_search": gz_search_q,
    "gz_roots": gz_roots_q,
    "scan_audit": scan_audit_q,
    "scan_totals": scan_totals_q,
    "export_txt": export_txt_q,
    "export_json": export_json_q,
    "export_page": export_page_q,
    "json_records": json_records_q,
    "stored_records": stored_records_q,
    "index_lookup": index_lookup_q,
    "report_rows": report_q,
    "query_key": query_key_q,
    "stream_search": stream_search_q,
    "stream_search_numbered": stream_search_numbered_q,
    "stream_totals": stream_totals_q,
    "stream_search_context": stream_context_q,
    "stream_batch_totals": stream_batch_totals_q,
}
