import os

from logsift.engine import LogEngine
from logsift.schemas import SearchSpec
from tests.conftest import APP_10, APP_11, SYS_10, write_gz


def test_engine_user_flow(spark, tmpdir_path):
    for h, body in (("10", APP_10), ("11", APP_11)):
        write_gz(f"{tmpdir_path}/logs/2026/04/07/{h}/app.gz", body)
    write_gz(f"{tmpdir_path}/logs/2026/04/07/10/sys.gz", SYS_10)
    eng = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", root=f"{tmpdir_path}/engine")
    fresh = LogEngine.from_gz(spark, f"{tmpdir_path}/logs", root=f"{tmpdir_path}/engine2")
    m = fresh.pruned_search("2026-04-07 10:45", "2026-04-07 10:50", ["error"], "OR")
    assert sorted((r.file_path.rsplit("/", 2)[-2], r.line_number) for r in m.collect()) == \
        [("10", 1), ("10", 2), ("10", 4)]
    spec = SearchSpec(keywords=("error",))
    info = eng.run(spec)
    assert info["total_matches"] == 5 and info["total_files"] == 3
    rows, pinfo = eng.page(spec, 2, 2)
    assert [r.result_no for r in rows.collect()] == [3, 4] and pinfo["total_pages"] == 3
    st = {(r.dim, r.label): r.cnt for r in eng.stats(spec).collect()}
    # the label is the whole part after the prefix ("TIMEOUT timeout" on one line)
    assert st[("error_codes", "TIMEOUT")] == 1 and st[("error_codes", "TIMEOUT timeout")] == 1
    eng.export(spec, "csv", f"{tmpdir_path}/out.csv")
    assert any(f.endswith(".csv") for f in os.listdir(f"{tmpdir_path}/out.csv"))
    s1 = eng.add_saved("errors", ["error"])
    eng.add_saved("auth", ["auth_fail"], path=f"file:{tmpdir_path}/logs/2026/04/07/11")
    hits = {(r.search_id, r.file_path, r.line_number) for r in eng.apply_saved().collect()}
    assert len([h for h in hits if h[0] == s1.id]) == 5 and len(hits) == 6
    eng.delete_saved(s1.id)
    assert [r.name for r in eng.saved_searches().collect()] == ["auth"]
    m = eng.pruned_search("2026-04-07 10:45", "2026-04-07 10:50", ["error"], "OR")
    # hour 10 only, token search: app.gz has lines 2 and 4, sys.gz line 1
    assert sorted((r.file_path.rsplit("/", 2)[-2], r.line_number) for r in m.collect()) == \
        [("10", 1), ("10", 2), ("10", 4)]
