"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def build(app: str = "textloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators expect; a cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only where that is unset
    (tests, a single machine) a temporary folder of this session takes its place."""
    at = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SHARED} to a folder all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            folder = tempfile.mkdtemp(prefix="textloom-")
            atexit.register(shutil.rmtree, folder, True)
            at = shared_dir.own = "file://" + folder
    return at.rstrip("/")


def _clean() -> None:
    """At the end of the process: what was cut and not released serves nobody any more."""
    for paths in _CUTS.values():
        for path in paths:
            try:
                if path.startswith(("file:", "/")):
                    shutil.rmtree(path.removeprefix("file:").replace("///", "/", 1), ignore_errors=True)
                elif (spark := SparkSession.getActiveSession()) is not None:
                    delete(spark, path)
            except Exception:  # a session that has ended; the folder's owner may clear it
                return


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _CUTS:
        atexit.unregister(_clean)
        atexit.register(_clean)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_CUTS: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes the tables cut so far, once no result that reads them is needed any more; returns how many."""
    mine = _CUTS.pop(spark.sparkContext.applicationId, [])
    for path in mine:
        delete(spark, path)
    return len(mine)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """df in enough partitions to use every core when few input splits hold much work per row."""
    n = at_least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fingerprint(df: DataFrame) -> str:
    """A name for the files a table is read from: their paths, lengths and times of change. The same tables have the same
    name in every process; a table that was written anew has another."""
    import hashlib

    spark = df.sparkSession
    h = hashlib.md5()
    for f in sorted(df.inputFiles()):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
        h.update(f"{f}|{s.getLen()}|{s.getModificationTime()}\n".encode())
    return h.hexdigest()


def bounded_broadcast(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which is counted up to that bound; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
