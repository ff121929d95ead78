"""Everything that must equal the reference for results to match.
Stated once, in the order a search meets them; the modules import from here."""

# Fixed values -- line format positions (1-based characters).
TIMESTAMP_LAYOUT = "yyyy-MM-dd HH:mm:ss"      # first 19 characters of a line
TIMESTAMP_CHARS = 19
TIME_OF_DAY_START, TIME_OF_DAY_LEN = 12, 5   # "HH:MM" at characters 12-16
TIME_OF_DAY_MIN_LINE = 19                    # shorter lines are not time-filtered
HOUR_START, HOUR_LEN = 12, 2                 # "HH" at characters 12-13
HOUR_MIN_LINE = 13
BOUND_LAYOUTS = ("%Y-%m-%d %H:%M", "%Y-%m-%d")  # query bounds; a bare end date means 23:59
HOUR_FOLDER_LAYOUT = "%Y/%m/%d/%H"           # root/YYYY/MM/DD/HH/*.gz

# Fixed values -- search.
REGEX_TERM = "regex"                         # matched terms of a regex search
MAX_CONTEXT = 10                             # context lines are clamped to 0..10

# Fixed values -- stats: line-part prefixes and their output lists, list lengths.
PART_DIMS = [("ERROR_CODE:", "error_codes"), ("API:", "api_endpoints"),
             ("BANK:", "banks"), ("USER:", "top_users")]
TOP_K = {"error_codes": 10, "api_endpoints": 10, "banks": 10, "top_users": 10,
         "matched_terms": 20, "timeline": 24}

# Fixed values -- pages.
PAGE_SIZE_DEFAULT = 25
PAGE_SIZE_MAX = 500

# Fixed values -- exports.
CSV_HEADER = ("file", "line_number", "matched_terms", "log_message")
REPORT_HEADER = ("Log Search Results\n==================\nRequest ID   : %s\n"
                 "Total Matches: %d\nCache Hit    : %s\n==================\n")
REPORT_ENTRY = "[%d] File: %s\n    Line %d: %s\n    Terms: [%s]\n"

# Fixed values -- token index: punctuation stripped from both ends, minimum bytes.
TOKEN_TRIM = ".,!?:;\"'()[]{}"
TOKEN_MIN_BYTES = 3

# Fixed values -- whitespace (Go's unicode.IsSpace): tab, newline, vertical tab,
# form feed, carriage return, space, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = (r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_CHARS = ("\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")

# Fixed values -- bloom filter sizing (per file).
BLOOM_ITEMS = 10_000
BLOOM_FPR = 0.01

# Fixed values -- minute index: "HH:MM" with digits 0-2/0-9 : 0-5/0-9, looked for at
# character 12 then at character 1; seeking starts this many lines early.
MINUTE_RE = r"^[0-2][0-9]:[0-5][0-9]\z"
MINUTE_AT = (12, 1)
SEEK_MARGIN = 1000
