"""Parameters of the registered queries, shared by the Spark plans and their SQL
checks.  Every query reads the whole supplied tables; these only choose what to
search for."""

from logsift.schemas import SavedSearch, SearchSpec

SEARCH_OR = SearchSpec(keywords=("timeout", "sbi"), mode="OR")
SEARCH_AND = SearchSpec(keywords=("error", "timeout"), mode="AND")
SEARCH_EXCLUDE = SearchSpec(keywords=("error",), exclude_keywords=("sbi", "hdfc"))
SEARCH_REGEX = SearchSpec(regex_pattern=r"bank:(sbi|fino).*error_code:(timeout|auth_fail)")
SEARCH_REGEX_CASE = SearchSpec(regex_pattern=r"ERROR_CODE:(TIMEOUT|AUTH_FAIL)", case_sensitive=True)
SEARCH_DOCS = SearchSpec(keywords=("ÉEAU", "Thon"), exclude_keywords=("THE",))
SEARCH_DOCS_REGEX = SearchSpec(regex_pattern=r"ÉEAU[a-z]+")
GZ_SEARCH = SearchSpec(keywords=("error", "timeout"), mode="AND", start_time="06:00", end_time="20:00")
GZ_DAY = "2024/01/03"  # the day folder that is browsed and searched
GZ_DAYS = ("2024/01/03", "2024/01/05")  # roots that are searched together
TIME_OF_DAY = SearchSpec(keywords=("error",), start_time="08:00", end_time="18:00")
TIME_RANGE = SearchSpec(keywords=("error",), start_ts="2024-01-03 10:00", end_ts="2024-01-05 18:30")
LINE_RANGE = SearchSpec(keywords=("info",), from_line=3, to_line=8)
HEAD_LINES = SearchSpec(keywords=("error",), max_lines_per_file=5)
MATCHED_TERMS = SearchSpec(keywords=("ERROR", "timeout", "SBI", "error"), mode="OR")
CONTEXT = SearchSpec(keywords=("timeout",), context_lines=2)
STATS = SearchSpec(keywords=("error", "sbi"), mode="OR")
TOTALS = SearchSpec(keywords=("auth_fail", "hdfc"), mode="OR", exclude_keywords=("signup",))
MAX_MATCHES = SearchSpec(keywords=("timeout",), max_matches=40)
LATEST = SearchSpec(keywords=("timeout",), max_matches=40, search_order="latest")
PAGED = SearchSpec(keywords=("error",))
PAGE, PAGE_SIZE = 3, 25
EXPORT = SearchSpec(keywords=("timeout", "fino"), mode="AND")
REPORT = SearchSpec(keywords=("auth_fail",), request_id="r-1")
KEYED = SearchSpec(keywords=("server_error",), request_id="ignored")

HOURS = ("2024-01-03 10:45", "2024-01-04 02:10")
PRUNE = dict(start="2024-01-03 10:45", end="2024-01-06 02:00",
             keywords=("error", "bank:sbi"), mode="AND")
BLOOM_PROBE = dict(keywords=("error", "bank:sbi"), mode="AND")
FILES_OR = ("thon", "éeau")
FILES_AND = ("that", "This", "with")
SEEK_TIME = "00:30"
SEEK_LONG = "23:59"
# An index built at this time covered the lines written before it.
INDEX_BUILT_AT = "2024-01-15 12:34:00"

SAVED = [
    SavedSearch("s1", "timeouts", ("timeout",), "OR", "", "2024-02-01 09:00:00"),
    SavedSearch("s2", "sbi errors", ("error", "bank:sbi"), "AND", "", "2024-02-01 09:05:00"),
    SavedSearch("s3", "day five auth", ("auth_fail",), "OR", "2024/01/05", "2024-02-01 09:10:00"),
    SavedSearch("s4", "day two purchases", ("purchase", "fino"), "OR", "2024/01/02", "2024-02-01 09:15:00"),
]
DELETED_SAVED = "s2"
# Saved searches are made of every user and every log file of the events.
MANY_USER, MANY_FILE = ("error",), ("timeout", "sbi")
SEGMENTS = 4  # parts in which growing log files arrive
