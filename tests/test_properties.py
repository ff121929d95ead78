"""Property tests: Spark search against a direct per-line model of the
reference's matching rules, on random lines and random searches."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logsift.operators.search import search
from logsift.schemas import SearchSpec
from tests.conftest import lines_df

WORDS = ["ERROR", "error", "Timeout", "timeout", "sbi", "SBI", "|", "USER:U1", "été", "ÉTÉ",
         "x", "ab", "BANK:FINO", ""]
TIMES = ["07:59", "08:00", "12:30", "18:00", "18:01", "23:59"]


@st.composite
def log_line(draw):
    body = " ".join(draw(st.lists(st.sampled_from(WORDS), max_size=6)))
    if draw(st.booleans()):
        return f"2026-04-07 {draw(st.sampled_from(TIMES))}:{draw(st.sampled_from(['00', '59']))} | {body}"
    return body


@st.composite
def spec(draw):
    use_regex = draw(st.booleans()) and draw(st.booleans())
    kws = tuple(draw(st.lists(st.sampled_from([w for w in WORDS if w]), min_size=1, max_size=3)))
    return SearchSpec(
        keywords=() if use_regex else kws,
        regex_pattern=draw(st.sampled_from(["error.*sbi", "t[iI]meout", "été", "^2026"])) if use_regex else "",
        case_sensitive=draw(st.booleans()),
        exclude_keywords=tuple(draw(st.lists(st.sampled_from(["fino", "ab", "ÉTÉ"]), max_size=1))),
        mode=draw(st.sampled_from(["AND", "OR", "weird"])),
        start_time=draw(st.sampled_from(["", "08:00", "12:30"])),
        end_time=draw(st.sampled_from(["", "18:00"])),
        max_lines_per_file=draw(st.sampled_from([0, 0, 3])),
    )


def model(line, n, s: SearchSpec):
    """The reference's rules for one line, written out directly."""
    if s.max_lines_per_file and n > s.max_lines_per_file:
        return None
    if (s.start_time or s.end_time) and len(line) >= 19:
        t, a, b = line[11:16], s.start_time.strip()[:5], s.end_time.strip()[:5]
        if (a and t < a) or (b and t > b):
            return None
    low = line.lower()
    if any(e.lower() in low for e in s.exclude_keywords):
        return None
    if s.regex_pattern:
        flags = 0 if s.case_sensitive else re.IGNORECASE
        return ["regex"] if re.search(s.regex_pattern, line, flags) else None
    terms = [k for k in s.keywords if k.lower() in low]
    mode = s.mode if s.mode in ("AND", "OR") else "OR"
    if (mode == "AND" and len(terms) != len(s.keywords)) or not terms:
        return None
    return terms


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lines=st.lists(log_line(), min_size=1, max_size=12), s=spec())
def test_search_matches_model(spark, lines, s):
    rows = [("f.gz" if i % 2 else "g.gz", line) for i, line in enumerate(lines)]
    got = {(r.file_path, r.line_number): r.matched_terms
           for r in search(lines_df(spark, rows), s).collect()}
    expect, counters = {}, {}
    for fp, line in rows:
        counters[fp] = counters.get(fp, 0) + 1
        terms = model(line, counters[fp], s)
        if terms is not None:
            expect[(fp, counters[fp])] = terms
    assert got == expect
