"""DuckDB SQL for every registered query -- the independent check of the Spark
plans.  Line views are rebuilt in SQL from the raw tables; search predicates are
generated from the same SearchSpec parameters."""

from __future__ import annotations

from dataclasses import replace

from logsift.plans import params as P
from logsift.schemas import SearchSpec

# Fixed values, written out here so that a wrong constant in the library fails the check.
TOKEN_TRIM = ".,!?:;\"'()[]{}"
WS_CLASS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
BLOOM_BITS, BLOOM_HASHES = 95_851, 7
SEEK_MARGIN = 1000
HOURS = "2024/01/03/10", "2024/01/04/02"  # first and last hour folder of params.HOURS
PRUNED_HOURS = "2024/01/03/10", "2024/01/06/02"  # and of params.PRUNE


# The text of params.KEYED that its key is made of: every field but the request id, by name.
KEY_TEXT = ('{"case_sensitive":false,"context_lines":0,"end_time":"","end_ts":"","exclude_keywords":[],"from_line":0,'
            '"keywords":["server_error"],"max_lines_per_file":0,"max_matches":0,"mode":"OR","regex_pattern":"",'
            '"search_order":"","search_path":"","start_time":"","start_ts":"","to_line":0}')


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NL = "chr(10)"

EVENT_LINES = """
ev AS (
  SELECT event_id, ts, strftime(ts, '%Y/%m/%d/%H') || '/app.log.gz' AS file_path,
    strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' ||
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END ||
    ' | USER:USR' || CAST(user_id AS VARCHAR) || ' | API:/' || event_type ||
    ' | AMOUNT:' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) ||
    ' | BANK:' || CASE user_id % 4 WHEN 0 THEN 'SBI' WHEN 1 THEN 'HDFC' WHEN 2 THEN 'FINO' ELSE 'AXIS' END ||
    CASE WHEN event_type = 'error' THEN ' | ERROR_CODE:' ||
      CASE event_id % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'SERVER_ERROR' ELSE 'AUTH_FAIL' END
    ELSE '' END AS line
  FROM events),
lines AS (
  SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY ts, event_id) AS BIGINT) AS line_number, line
  FROM ev)"""

DOC_LINES = f"""
dsplit AS (
  SELECT source || '/' || CAST(doc_id AS VARCHAR) AS file_path, string_split(text, {NL}) AS parts
  FROM documents),
lines AS (
  SELECT file_path, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_number,
         regexp_replace(unnest(parts), '\\r\\z', '') AS line
  FROM dsplit)"""


def with_lines(body: str, docs: bool = False, extra: str = "") -> str:
    ctes = DOC_LINES if docs else EVENT_LINES
    return f"WITH {ctes}{',' + extra if extra else ''}\n{body}"


def _hits(keywords, line="line"):
    return [f"contains(lower({line}), lower({q(k)}))" for k in keywords]


def pred(spec: SearchSpec, line: str = "line", line_number: str = "line_number") -> str:
    spec = spec.normalized()
    parts = []
    if spec.search_path:
        p = spec.search_path.rstrip("/")
        parts.append(f"(file_path = {q(p)} OR starts_with(file_path, {q(p + '/')}))")
    if spec.from_line > 0:
        parts.append(f"{line_number} >= {spec.from_line}")
    if spec.to_line > 0:
        parts.append(f"{line_number} <= {spec.to_line}")
    if spec.max_lines_per_file > 0:
        parts.append(f"{line_number} <= {spec.max_lines_per_file}")
    if spec.start_time or spec.end_time:
        s, e = spec.start_time.strip()[:5], spec.end_time.strip()[:5]
        conds = []
        if s:
            conds.append(f"substr({line}, 12, 5) >= {q(s)}")
        if e:
            conds.append(f"substr({line}, 12, 5) <= {q(e)}")
        if conds:
            parts.append(f"(length({line}) < 19 OR ({' AND '.join(conds)}))")
    if spec.start_ts or spec.end_ts:
        ts = f"try_strptime(substr({line}, 1, 19), '%Y-%m-%d %H:%M:%S')"
        conds = []
        if spec.start_ts:
            conds.append(f"{ts} >= TIMESTAMP {q(spec.start_ts + ':00')}")
        if spec.end_ts:
            conds.append(f"{ts} <= TIMESTAMP {q(spec.end_ts + ':00')}")
        parts.append(f"({ts} IS NULL OR ({' AND '.join(conds)}))")
    if spec.exclude_keywords:
        parts.append("NOT (" + " OR ".join(_hits(spec.exclude_keywords, line)) + ")")
    if spec.regex_pattern:
        pat = spec.regex_pattern if spec.case_sensitive else "(?i)" + spec.regex_pattern
        parts.append(f"regexp_matches({line}, {q(pat)})")
    else:
        joiner = " AND " if spec.mode == "AND" else " OR "
        parts.append("(" + joiner.join(_hits(spec.keywords, line)) + ")")
    return " AND ".join(parts)


def terms_list(spec: SearchSpec, line: str = "line") -> str:
    spec = spec.normalized()
    if spec.regex_pattern:
        return "['regex']"
    items = ", ".join(f"CASE WHEN {h} THEN {q(k)} END"
                      for k, h in zip(spec.keywords, _hits(spec.keywords, line)))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def terms_str(spec: SearchSpec, line: str = "line") -> str:
    return f"array_to_string({terms_list(spec, line)}, '|')"


def search_sql(spec: SearchSpec, docs: bool = False) -> str:
    body = (f"SELECT file_path, line_number, line AS line_text, {terms_str(spec)} AS matched_terms "
            f"FROM lines WHERE {pred(spec)}")
    if spec.max_matches > 0:
        fp = "file_path DESC" if spec.search_order == "latest" else "file_path"
        body += f" ORDER BY {fp}, line_number LIMIT {spec.max_matches}"
    return with_lines(body, docs)


def context_sql(spec: SearchSpec) -> str:
    c = max(0, min(spec.context_lines, 10))
    body = f"""
SELECT file_path, line_number, CAST(greatest(line_number - {c}, 1) AS BIGINT) AS context_start, context
FROM (SELECT *, array_to_string(list(line) OVER (PARTITION BY file_path ORDER BY line_number
        ROWS BETWEEN {c} PRECEDING AND {c} FOLLOWING), {NL}) AS context FROM lines)
WHERE {pred(spec)}"""
    return with_lines(body)


WS = f"{WS_CLASS}+"


def stats_sql(spec: SearchSpec, dims: list[str] | None = None, only_dim: str | None = None) -> str:
    trim = f"regexp_replace(p, '^{WS}|{WS}$', '', 'g')"
    extra = f"""
m AS (SELECT line AS line_text, {terms_list(spec)} AS terms FROM lines WHERE {pred(spec)}),
parts AS (SELECT {trim} AS p FROM (SELECT unnest(string_split(line_text, '|')) AS p FROM m)),
facts AS (
  SELECT CASE WHEN starts_with(p, 'ERROR_CODE:') THEN 'error_codes'
              WHEN starts_with(p, 'API:') THEN 'api_endpoints'
              WHEN starts_with(p, 'BANK:') THEN 'banks'
              WHEN starts_with(p, 'USER:') THEN 'top_users' END AS dim,
         CASE WHEN starts_with(p, 'ERROR_CODE:') THEN substr(p, 12)
              WHEN starts_with(p, 'API:') THEN substr(p, 5)
              WHEN starts_with(p, 'BANK:') THEN substr(p, 6)
              WHEN starts_with(p, 'USER:') THEN substr(p, 6) END AS label
  FROM parts
  UNION ALL
  SELECT 'timeline', substr(line_text, 12, 2) || ':00' FROM m WHERE length(line_text) >= 13
  UNION ALL
  SELECT 'matched_terms', unnest(terms) FROM m),
counts AS (
  SELECT dim, label, count(*) AS cnt FROM facts
  WHERE dim IS NOT NULL AND (dim <> 'timeline' OR regexp_full_match(label, '([01][0-9]|2[0-3]):00'))
  GROUP BY dim, label),
ranked AS (
  SELECT dim, label, cnt, CAST(row_number() OVER (PARTITION BY dim ORDER BY
    CASE WHEN dim = 'timeline' THEN 0 ELSE -cnt END, label) AS BIGINT) AS rk FROM counts)"""
    limit = "CASE dim WHEN 'matched_terms' THEN 20 WHEN 'timeline' THEN 24 ELSE 10 END"
    if only_dim:
        body = f"SELECT label, cnt, rk FROM ranked WHERE dim = {q(only_dim)} AND rk <= {limit}"
    else:
        body = f"SELECT dim, label, cnt, rk FROM ranked WHERE rk <= {limit}"
    return with_lines(body, extra=extra)


def totals_sql(spec: SearchSpec) -> str:
    body = f"""
SELECT count(DISTINCT file_path) AS files_total, count(DISTINCT file_path) AS files_searched,
  count(*) AS lines_scanned, count(*) FILTER (WHERE {pred(spec)}) AS matches_found,
  CAST(100 AS BIGINT) AS percent, CAST(coalesce(sum(strlen(line) + 1), 0) AS BIGINT) AS searched_size
FROM lines"""
    return with_lines(body)


def page_sql(spec: SearchSpec, page: int, size: int) -> str:
    lo = (page - 1) * size
    body = f"""
SELECT file_path, line_number, line_text, matched_terms, result_no FROM (
  SELECT file_path, line_number, line AS line_text, {terms_str(spec)} AS matched_terms,
    CAST(row_number() OVER (ORDER BY file_path, line_number) AS BIGINT) AS result_no
  FROM lines WHERE {pred(spec)})
WHERE result_no > {lo} AND result_no <= {lo + size}"""
    return with_lines(body)


def hour_folders_sql() -> str:
    s, e = HOURS
    body = f"""
SELECT file_path, count(*) AS n_lines FROM lines
WHERE substr(file_path, 1, 13) BETWEEN {q(s)} AND {q(e)}
GROUP BY file_path"""
    return with_lines(body)


TOKENS = f"list_filter(regexp_split_to_array(line, '{WS}'), lambda t: t <> '')"


def index_cte(source: str = "lines", name: str = "idx") -> str:
    return f"""
{name} AS (
  SELECT DISTINCT file_path, keyword FROM (
    SELECT file_path, lower(trim(tok, {q(TOKEN_TRIM)})) AS keyword
    FROM (SELECT file_path, unnest({TOKENS}) AS tok FROM {source}))
  WHERE strlen(keyword) >= 3)"""


def files_sql(keywords, mode: str) -> str:
    keys = list(dict.fromkeys(k.lower() for k in keywords))
    inlist = ", ".join(q(k) for k in keys)
    if mode == "OR":
        body = f"SELECT DISTINCT file_path FROM idx WHERE keyword IN ({inlist})"
    else:
        body = (f"SELECT file_path FROM idx WHERE keyword IN ({inlist}) GROUP BY file_path "
                f"HAVING count(DISTINCT keyword) = {len(keys)}")
    return with_lines(body, docs=True, extra=index_cte())


def bloom_cte(source: str = "lines") -> str:
    h1 = "CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT)"
    h2 = "CAST(('0x' || substr(md5(token), 9, 8)) AS BIGINT)"
    return f"""
btok AS (SELECT DISTINCT file_path, lower(tok) AS token
         FROM (SELECT file_path, unnest({TOKENS}) AS tok FROM {source})),
bbits AS (SELECT DISTINCT file_path, ({h1} + i * {h2}) % {BLOOM_BITS} AS bit
          FROM btok, range(0, {BLOOM_HASHES}) r(i)),
blooms AS (SELECT file_path, list(bit ORDER BY bit) AS bits FROM bbits GROUP BY file_path)"""


def bloom_test(keywords, mode: str) -> str:
    tests = []
    for k in keywords:
        tok = q(k.lower())
        h1 = f"CAST(('0x' || substr(md5({tok}), 1, 8)) AS BIGINT)"
        h2 = f"CAST(('0x' || substr(md5({tok}), 9, 8)) AS BIGINT)"
        tests.append(f"list_has_all(bits, [({h1} + i * {h2}) % {BLOOM_BITS} "
                     f"FOR i IN range(0, {BLOOM_HASHES})])")
    return (" AND " if mode == "AND" else " OR ").join(tests)


def bloom_build_sql() -> str:
    body = """
SELECT file_path, CAST(sum(n) AS BIGINT) AS n_bits,
       md5(string_agg(CAST(word AS VARCHAR) || ':' || hex(bits), ',' ORDER BY word)) AS bits_md5
FROM (SELECT file_path, bit // 64 AS word, count(*) AS n, bit_or(CAST(1 AS UBIGINT) << CAST(bit % 64 AS UBIGINT)) AS bits
      FROM bbits GROUP BY ALL) GROUP BY file_path"""
    return with_lines(body, extra=bloom_cte())


def bloom_probe_sql() -> str:
    body = f"SELECT file_path FROM blooms WHERE {bloom_test(**P.BLOOM_PROBE)}"
    return with_lines(body, extra=bloom_cte())


def prune_sql() -> str:
    s, e = PRUNED_HOURS
    keys = list(dict.fromkeys(k.lower() for k in P.PRUNE["keywords"]))
    inlist = ", ".join(q(k) for k in keys)
    extra = f"""
inrange AS (SELECT * FROM lines WHERE substr(file_path, 1, 13) BETWEEN {q(s)} AND {q(e)}),
{bloom_cte('inrange')},
{index_cte('inrange')}"""
    body = f"""
SELECT file_path FROM blooms WHERE {bloom_test(P.PRUNE['keywords'], P.PRUNE['mode'])}
AND file_path IN (SELECT file_path FROM idx WHERE keyword IN ({inlist}) GROUP BY file_path
                  HAVING count(DISTINCT keyword) = {len(keys)})"""
    return with_lines(body, extra=extra)


def pruned_search_sql() -> str:
    spec = SearchSpec(keywords=P.PRUNE["keywords"], mode=P.PRUNE["mode"])
    s, e = PRUNED_HOURS
    keys = list(dict.fromkeys(k.lower() for k in P.PRUNE["keywords"]))
    inlist = ", ".join(q(k) for k in keys)
    extra = f"""
inrange AS (SELECT * FROM lines WHERE substr(file_path, 1, 13) BETWEEN {q(s)} AND {q(e)}),
{bloom_cte('inrange')},
{index_cte('inrange')},
cands AS (SELECT file_path FROM blooms WHERE {bloom_test(P.PRUNE['keywords'], P.PRUNE['mode'])}
  AND file_path IN (SELECT file_path FROM idx WHERE keyword IN ({inlist}) GROUP BY file_path
                    HAVING count(DISTINCT keyword) = {len(keys)}))"""
    body = (f"SELECT file_path, line_number, line AS line_text, {terms_str(spec)} AS matched_terms "
            f"FROM inrange WHERE file_path IN (SELECT file_path FROM cands) AND {pred(spec)}")
    return with_lines(body, extra=extra)


MINUTES_CTE = """
mm AS (SELECT file_path, line_number,
  CASE WHEN regexp_full_match(substr(line, 12, 5), '[0-2][0-9]:[0-5][0-9]') THEN substr(line, 12, 5)
       WHEN regexp_full_match(substr(line, 1, 5), '[0-2][0-9]:[0-5][0-9]') THEN substr(line, 1, 5) END AS minute
  FROM lines),
minidx AS (SELECT file_path, minute, line_number FROM (
  SELECT *, lag(minute) OVER (PARTITION BY file_path ORDER BY line_number) AS prev FROM mm WHERE minute IS NOT NULL)
  WHERE prev IS NULL OR prev <> minute)"""


def minute_index_sql() -> str:
    return with_lines("SELECT file_path, minute, line_number FROM minidx", extra=MINUTES_CTE)


def seek_line_sql() -> str:
    t = q(P.SEEK_TIME.strip()[:5])
    extra = MINUTES_CTE + f""",
gt AS (SELECT file_path, min(line_number) FILTER (WHERE minute > {t}) AS g FROM minidx GROUP BY file_path),
found AS (SELECT i.file_path, max(i.line_number) FILTER (WHERE g.g IS NULL OR i.line_number < g.g) AS r
          FROM minidx i JOIN gt g USING (file_path) GROUP BY i.file_path)"""
    body = f"""
SELECT f.file_path, CAST(greatest(coalesce(r, 0) - {SEEK_MARGIN}, 0) AS BIGINT) AS start_line
FROM (SELECT DISTINCT file_path FROM lines) f LEFT JOIN found USING (file_path)"""
    return with_lines(body, extra=extra)


def seek_line_long_sql() -> str:
    # 1000: the margin, written out so that the check does not share the constant
    cte = MINUTES_CTE.replace("lines", "longlines")
    extra = f"""
longlines AS (SELECT substr(file_path, 1, 7) AS file_path, line,
              row_number() OVER (PARTITION BY substr(file_path, 1, 7) ORDER BY file_path, line_number) AS line_number
              FROM lines),{cte},
gt AS (SELECT file_path, min(line_number) FILTER (WHERE minute > '23:59') AS g FROM minidx GROUP BY file_path),
found AS (SELECT i.file_path, max(i.line_number) FILTER (WHERE g.g IS NULL OR i.line_number < g.g) AS r
          FROM minidx i JOIN gt g USING (file_path) GROUP BY i.file_path)"""
    body = """
SELECT file_path, CAST(greatest(r - 1000, 0) AS BIGINT) AS start_line, CAST(greatest(r, 0) AS BIGINT) AS entry_line
FROM found"""
    return with_lines(body, extra=extra)


def seek_search_sql() -> str:
    found = seek_line_long_sql().rsplit("\nSELECT", 1)[0]
    return found + f"""
SELECT l.file_path, l.line_number, l.line AS line_text, {terms_str(P.SEARCH_AND, "l.line")} AS matched_terms
FROM longlines l LEFT JOIN found f USING (file_path)
WHERE l.line_number >= greatest(coalesce(f.r, 0) - 1000, 0) AND {pred(P.SEARCH_AND, "l.line", "l.line_number")}"""


def _versions_cte() -> str:
    ts = "try_strptime(substr(line, 1, 19), '%Y-%m-%d %H:%M:%S')"
    built = f"TIMESTAMP {q(P.INDEX_BUILT_AT)}"
    return f"""
oldlines AS (SELECT * FROM lines WHERE {ts} <= {built}),
inventory AS (SELECT file_path, max({ts}) AS modified FROM lines GROUP BY file_path),
built AS (SELECT DISTINCT file_path, {built} AS built_at FROM oldlines),
stale AS (SELECT i.file_path, i.modified, b.built_at FROM inventory i LEFT JOIN built b USING (file_path)
          WHERE b.built_at IS NULL OR i.modified > b.built_at)"""


def stale_files_sql() -> str:
    return with_lines("SELECT file_path, modified, built_at FROM stale", extra=_versions_cte())


def index_replace_sql() -> str:
    extra = _versions_cte() + "," + index_cte("oldlines", "oldidx") + "," + \
        index_cte("(SELECT * FROM lines WHERE file_path IN (SELECT file_path FROM stale))", "newidx")
    body = """
SELECT file_path, keyword FROM oldidx WHERE file_path NOT IN (SELECT file_path FROM stale)
UNION ALL SELECT file_path, keyword FROM newidx"""
    return with_lines(body, extra=extra)


def index_refresh_sql() -> str:
    extra = index_cte("(SELECT * FROM lines WHERE NOT starts_with(file_path, '2024/01/03/'))")
    return with_lines("SELECT file_path, keyword FROM idx", extra=extra)


def saved_many_sql() -> str:
    body = r"""
SELECT 'user ' || regexp_extract(line, 'USER:USR(-?[0-9]+) \|', 1) AS search_id, file_path, line_number
FROM lines WHERE contains(lower(line), 'error') AND regexp_matches(line, 'USER:USR-?[0-9]+ \|')
UNION ALL SELECT 'file ' || file_path, file_path, line_number
FROM lines WHERE contains(lower(line), 'timeout') OR contains(lower(line), 'sbi')"""
    return with_lines(body)


def stream_batch_totals_sql(spec: SearchSpec) -> str:
    return with_lines(f"SELECT count(*) AS lines_scanned, count(*) FILTER (WHERE {pred(spec)}) AS matches_found FROM lines")


def saved_sql(searches) -> str:
    arms = []
    for s in sorted(searches, key=lambda s: s.id):
        hits = _hits(s.keywords)
        cond = "(" + (" AND " if s.mode == "AND" else " OR ").join(hits) + ")"
        if s.path:
            p = s.path.rstrip("/")
            cond = f"(file_path = {q(p)} OR starts_with(file_path, {q(p + '/')})) AND {cond}"
        arms.append(f"SELECT {q(s.id)} AS search_id, file_path, line_number FROM lines WHERE {cond}")
    return with_lines("\nUNION ALL\n".join(arms))


def export_sql(spec: SearchSpec) -> str:
    body = f"""
SELECT regexp_extract(file_path, '[^/]*$') AS file, line_number, {terms_str(spec)} AS matched_terms,
       line AS log_message FROM lines WHERE {pred(spec)}"""
    return with_lines(body)


def report_sql(spec: SearchSpec) -> str:
    nl = NL
    extra = f"""
m AS (SELECT file_path, line_number, line, {terms_list(spec)} AS terms,
        CAST(row_number() OVER (ORDER BY file_path, line_number) AS BIGINT) AS result_no
      FROM lines WHERE {pred(spec)})"""
    body = f"""
SELECT CAST(0 AS BIGINT) AS result_no,
  'Log Search Results' || {nl} || '==================' || {nl} || 'Request ID   : ' || {q(spec.request_id)} || {nl} ||
  'Total Matches: ' || CAST((SELECT count(*) FROM m) AS VARCHAR) || {nl} || 'Cache Hit    : false' || {nl} ||
  '==================' || {nl} AS text
UNION ALL
SELECT result_no, '[' || CAST(result_no AS VARCHAR) || '] File: ' || regexp_extract(file_path, '[^/]*$') || {nl} ||
  '    Line ' || CAST(line_number AS VARCHAR) || ': ' || line || {nl} ||
  '    Terms: [' || array_to_string(terms, ' ') || ']' || {nl} AS text
FROM m"""
    return with_lines(body, extra=extra)


def query_key_sql(spec: SearchSpec) -> str:
    body = f"""
SELECT sha256({q(KEY_TEXT)} || '|' || CAST(files AS VARCHAR) || '|' || CAST(size AS VARCHAR)) AS query_key,
       matches AS total_matches, files AS total_files, size AS searched_size
FROM (SELECT count(DISTINCT file_path) AS files, count(*) FILTER (WHERE {pred(spec)}) AS matches,
             CAST(coalesce(sum(strlen(line) + 1), 0) AS BIGINT) AS size FROM lines)"""
    return with_lines(body)


def stream_search_sql(spec: SearchSpec) -> str:
    body = (f"SELECT file_path, line AS line_text, {terms_str(spec)} AS matched_terms "
            f"FROM lines WHERE {pred(spec)}")
    return with_lines(body)


def stream_totals_sql(spec: SearchSpec) -> str:
    body = f"""
SELECT count(DISTINCT file_path) AS files_total, count(*) AS lines_scanned,
       count(*) FILTER (WHERE {pred(spec)}) AS matches_found FROM lines"""
    return with_lines(body)


def gz_roots_sql() -> str:
    days = ", ".join(q(d) for d in ("2024/01/03", "2024/01/05"))
    body = (f"SELECT file_path, line_number, line AS line_text, {terms_str(P.GZ_SEARCH)} AS matched_terms "
            f"FROM lines WHERE substr(file_path, 1, 10) IN ({days}) AND {pred(P.GZ_SEARCH)}")
    return with_lines(body)


def scan_audit_sql() -> str:
    body = """
SELECT 'read' AS status, CAST(NULL AS VARCHAR) AS reason, count(DISTINCT file_path) AS files, count(*) AS lines,
       true AS some_lines FROM lines
UNION ALL SELECT 'unreadable', 'not gzip', 1, 0, false
UNION ALL SELECT 'empty', 'no lines', 1, 0, false
UNION ALL SELECT 'cut', 'ends before the size in its trailer', 1, NULL, true"""
    return with_lines(body)


def scan_totals_sql() -> str:
    # three planted files, of which one can't be searched
    body = f"""
SELECT files + 3 AS files_total, files + 2 AS files_searched, matches AS matches_found,
       CAST((files + 2) * 100 // (files + 3) AS BIGINT) AS percent, true AS bytes_read
FROM (SELECT count(DISTINCT file_path) AS files, count(*) FILTER (WHERE {pred(P.GZ_SEARCH)}) AS matches FROM lines)"""
    return with_lines(body)


def export_txt_sql() -> str:
    return with_lines(f"SELECT line AS line_text FROM lines WHERE {pred(P.EXPORT)}")


def export_page_sql() -> str:
    extra = f"""
page AS (SELECT line FROM lines WHERE {pred(P.EXPORT)} ORDER BY file_path, line_number LIMIT 10)"""
    return with_lines("SELECT f AS format, line AS log_message FROM page, (VALUES ('csv'), ('json'), ('text')) v(f)",
                      extra=extra)


def json_records_sql() -> str:
    body = f"""
SELECT file_path, line_number, CAST(greatest(line_number - 2, 1) AS BIGINT) AS context_start,
       {terms_str(P.CONTEXT)} AS matched_terms, context, line AS line_text
FROM (SELECT *, array_to_string(list(line) OVER (PARTITION BY file_path ORDER BY line_number
        ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), {NL}) AS context FROM lines)
WHERE {pred(P.CONTEXT)}"""
    return with_lines(body)


def browse_sql() -> str:
    return f"""
SELECT 'h=' || strftime(ts, '%H') AS name, true AS is_dir, CAST(0 AS BIGINT) AS size, CAST(1 AS INTEGER) AS gz_count
FROM events WHERE strftime(ts, '%Y/%m/%d') = {q(P.GZ_DAY)} GROUP BY 1"""


def oracle() -> dict[str, str]:
    deleted = [s for s in P.SAVED if s.id != P.DELETED_SAVED]
    return {
        "search_or": search_sql(P.SEARCH_OR),
        "search_and": search_sql(P.SEARCH_AND),
        "search_exclude": search_sql(P.SEARCH_EXCLUDE),
        "search_regex": search_sql(P.SEARCH_REGEX),
        "search_regex_case": search_sql(P.SEARCH_REGEX_CASE),
        "search_docs": search_sql(P.SEARCH_DOCS, docs=True),
        "search_docs_regex": search_sql(P.SEARCH_DOCS_REGEX, docs=True),
        "time_of_day": search_sql(P.TIME_OF_DAY),
        "time_range": search_sql(P.TIME_RANGE),
        "line_range": search_sql(P.LINE_RANGE),
        "head_lines": search_sql(P.HEAD_LINES),
        "matched_terms": search_sql(P.MATCHED_TERMS),
        "context_join": context_sql(P.CONTEXT),
        "context_window": context_sql(P.CONTEXT),
        "error_codes": stats_sql(P.STATS, only_dim="error_codes"),
        "api_endpoints": stats_sql(P.STATS, only_dim="api_endpoints"),
        "banks": stats_sql(P.STATS, only_dim="banks"),
        "top_users": stats_sql(P.STATS, only_dim="top_users"),
        "timeline": stats_sql(P.STATS, only_dim="timeline"),
        "term_counts": stats_sql(P.STATS, only_dim="matched_terms"),
        "stats_topk": stats_sql(P.STATS),
        "search_totals": totals_sql(P.TOTALS),
        "max_matches": search_sql(P.MAX_MATCHES),
        "order_latest": search_sql(P.LATEST),
        "page": page_sql(P.PAGED, P.PAGE, P.PAGE_SIZE),
        "page_repeat": page_sql(P.PAGED, P.PAGE, P.PAGE_SIZE),
        "hour_folders": hour_folders_sql(),
        "browse": browse_sql(),
        "search_path_gz": search_sql(replace(P.GZ_SEARCH, search_path=P.GZ_DAY)),
        "inverted_index": with_lines("SELECT file_path, keyword FROM idx", docs=True, extra=index_cte()),
        "files_or": files_sql(P.FILES_OR, "OR"),
        "files_and": files_sql(P.FILES_AND, "AND"),
        "files_union": files_sql(P.FILES_OR, "OR"),
        "files_intersect": files_sql(P.FILES_AND, "AND"),
        "bloom_build": bloom_build_sql(),
        "bloom_probe": bloom_probe_sql(),
        "prune_candidates": prune_sql(),
        "pruned_search": pruned_search_sql(),
        "minute_index": minute_index_sql(),
        "seek_line": seek_line_sql(),
        "seek_line_long": seek_line_long_sql(),
        "seek_search": seek_search_sql(),
        "index_replace": index_replace_sql(),
        "stale_files": stale_files_sql(),
        "index_refresh": index_refresh_sql(),
        "saved_search_many": saved_many_sql(),
        "stream_search_context": context_sql(P.CONTEXT),
        "stream_batch_totals": stream_batch_totals_sql(P.SEARCH_OR),
        "saved_search_apply": saved_sql(P.SAVED),
        "saved_search_delete": saved_sql(deleted),
        "export_csv_rows": export_sql(P.EXPORT),
        "gz_search": search_sql(P.GZ_SEARCH),
        "gz_roots": gz_roots_sql(),
        "scan_audit": scan_audit_sql(),
        "scan_totals": scan_totals_sql(),
        "export_txt": export_txt_sql(),
        "export_json": export_sql(P.EXPORT),
        "export_page": export_page_sql(),
        "json_records": json_records_sql(),
        "stored_records": search_sql(P.EXPORT),
        "index_lookup": files_sql(P.FILES_OR, "OR"),
        "report_rows": report_sql(P.REPORT),
        "query_key": query_key_sql(P.KEYED),
        "stream_search": stream_search_sql(P.SEARCH_OR),
        "stream_search_numbered": search_sql(P.SEARCH_AND),
        "stream_totals": stream_totals_sql(P.SEARCH_OR),
    }
