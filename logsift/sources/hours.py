"""Hour-folder selection (SRC4): ``root/YYYY/MM/DD/HH/*.gz`` for every hour from
start to end.  Expressed as a predicate on ``file_path`` (and on the ``dt``
partition of an ingested table), so Spark prunes partitions, row groups and
files instead of listing folders one by one."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.fixed import BOUND_LAYOUTS


def _parse(text: str, is_end: bool) -> datetime:
    t = (text or "").strip()
    with_time, date_only = BOUND_LAYOUTS
    try:
        return datetime.strptime(t, with_time)
    except ValueError:
        pass
    try:
        d = datetime.strptime(t, date_only)
    except ValueError:
        raise ValueError(f"invalid {'end' if is_end else 'start'}_time format: {text}") from None
    # a bare end date means the whole day (23:59)
    return d + timedelta(hours=23, minutes=59) if is_end else d


def hour_bounds(start: str, end: str) -> tuple[str, str]:
    """First and last hour folder (``yyyy/MM/dd/HH``).  The start is truncated to
    its hour, so 10:45-11:15 covers folders 10 and 11."""
    s = _parse(start, False).replace(minute=0)
    e = _parse(end, True)
    return s.strftime("%Y/%m/%d/%H"), e.strftime("%Y/%m/%d/%H")


def hour_list(start: str, end: str) -> list[str]:
    s, e = hour_bounds(start, end)
    cur, last, out = datetime.strptime(s, "%Y/%m/%d/%H"), datetime.strptime(e, "%Y/%m/%d/%H"), []
    while cur <= last:
        out.append(cur.strftime("%Y/%m/%d/%H"))
        cur += timedelta(hours=1)
    return out


def day_of(file_path: Column | str, root: str = "") -> Column:
    """The day (``yyyy-MM-dd``, the ``dt`` of an ingested table) of a file below ``root``."""
    start = len(root.rstrip("/")) + 2 if root else 1
    return F.regexp_replace(F.substring(file_path, start, 10), "/", "-")


def hour_folder_filter(start: str, end: str, root: str = "",
                       file_path: Column | None = None,
                       dt: Column | None = None) -> Column:
    """Files directly inside an hour folder in range.  ``root`` is the prefix as it
    appears in ``file_path`` (empty for the ingested events table).  Pass ``dt`` for
    a day-partitioned table to add partition pruning."""
    file_path = F.col("file_path") if file_path is None else file_path
    s, e = hour_bounds(start, end)
    prefix = (root.rstrip("/") + "/") if root else ""
    # '0' is the character right after '/', so this is a prefix range on the path
    cond = (file_path >= F.lit(prefix + s + "/")) & (file_path < F.lit(prefix + e + "0"))
    hour = F.regexp_extract(file_path, r"(\d{4}/\d{2}/\d{2}/\d{2})/[^/]+\.gz$", 1)
    cond = cond & hour.between(F.lit(s), F.lit(e)) & \
        F.substring(file_path, len(prefix) + 1, 13).between(F.lit(s), F.lit(e)) & \
        (F.locate("/", file_path, len(prefix) + 15) == 0)
    if dt is not None:
        cond = cond & dt.between(F.lit(s[:10].replace("/", "-")), F.lit(e[:10].replace("/", "-")))
    return cond
