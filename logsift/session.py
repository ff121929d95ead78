"""Session helpers: building a session for tests/bench, the shared work folder,
paths and staged tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "logsift",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Session for tests and the bench.  On a cluster, use the session you are given."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written tables.

    Reads the checkpoint folder the cluster names (``spark.checkpoint.dir`` or an
    already set SparkContext checkpoint dir).  Only when none is set *and* the
    master is local (tests) do we make one under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder the "
                "executors can reach")
        conf_dir = tempfile.mkdtemp(prefix="logsift-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared work folder (or ``path``) and
    read it back.

    Cuts the lineage like ``checkpoint()`` (the rows survive executor loss and
    nondeterministic columns are fixed), but in one job and in columnar form;
    an eager RDD checkpoint computes its input twice."""
    auto = path is None
    path = path or f"{work_dir(df.sparkSession)}/staging/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if auto:  # nobody else knows the folder: it goes when the application ends
        fs, hpath = _fs(df.sparkSession, path)
        fs.deleteOnExit(hpath)
    return df.sparkSession.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of ``path`` -- the Hadoop client Spark itself uses, so
    local folders, HDFS and object stores behave the same."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a staging folder."""
    fs, hpath = _fs(spark, path)
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return bool(fs.exists(hpath))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as ``file_path`` shows it: scheme and authority of its file system (the
    session's default one for a plain path), decoded (a blank stays a blank)."""
    fs, hpath = _fs(spark, path)
    return fs.makeQualified(hpath).toString()


def path_state(spark: SparkSession, path: str) -> str:
    """Digest of the names, sizes and times of a file or of all files under a folder: the
    part of a key that changes when the source changes.  A listing; no file is opened."""
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return "missing"
    files, it = [], fs.listFiles(hpath, True)
    while it.hasNext():
        f = it.next()
        files.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(files)).encode()).hexdigest()
