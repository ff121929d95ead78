import gzip
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[4]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from logsift.session import work_dir
    work_dir(spark)  # reads spark.checkpoint.dir, sets a temp one only if unset
    yield spark


def write_gz(path, text: str | bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    data = text.encode() if isinstance(text, str) else text
    with gzip.open(path, "wb") as f:
        f.write(data)


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="logsift-test-")


# Made-up log lines in the reference's documented format.
APP_10 = "\n".join([
    "2026-04-07 10:00:01 | INFO | USER:USR0001 | API:/login | BANK:SBI",
    "2026-04-07 10:00:02 | ERROR | USER:USR0002 | API:/payment | BANK:HDFC | ERROR_CODE:SERVER_ERROR",
    "2026-04-07 10:01:03 | INFO | USER:USR0003 | API:/balance | BANK:FINO",
    "2026-04-07 10:02:04 | ERROR | USER:USR0004 | API:/payment | BANK:SBI | ERROR_CODE:TIMEOUT timeout",
    "2026-04-07 10:03:05 | INFO | USER:USR0005 | API:/logout | BANK:AXIS",
]) + "\n"
APP_11 = "\n".join([
    "2026-04-07 11:00:01 | ERROR | USER:USR0006 | API:/login | BANK:SBI | ERROR_CODE:AUTH_FAIL",
    "2026-04-07 11:00:02 | INFO | USER:USR0007 | API:/login | BANK:SBI",
    "2026-04-07 11:05:03 | ERROR | USER:USR0008 | API:/payment | BANK:FINO | ERROR_CODE:TIMEOUT",
]) + "\n"
SYS_10 = "2026-04-07 10:10:00 | ERROR | disk full\n2026-04-07 10:11:00 | INFO | ok\n"
CLEAN_10 = "2026-04-07 10:20:00 | INFO | all good\n"


@pytest.fixture()
def ref_logs(tmpdir_path):
    d = os.path.join(tmpdir_path, "testdata")
    write_gz(f"{d}/app-2026-04-07-10.log.gz", APP_10)
    write_gz(f"{d}/app-2026-04-07-11.log.gz", APP_11)
    write_gz(f"{d}/sys-2026-04-07-10.log.gz", SYS_10)
    write_gz(f"{d}/clean-2026-04-07-10.log.gz", CLEAN_10)
    return d


def lines_df(spark, rows):
    """rows: list of (file_path, line) in file order -> numbered log_lines."""
    out, counters = [], {}
    for fp, line in rows:
        counters[fp] = counters.get(fp, 0) + 1
        out.append((fp, counters[fp], line))
    return spark.createDataFrame(out, "file_path string, line_number long, line string")
