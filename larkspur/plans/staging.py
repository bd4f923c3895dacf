"""Tables written to the folder that driver and executors share, so that a result is worked out once and survives lost executors."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
#: Folder -> the session that wrote it, and a weak reference to what every plan that reads it holds.
_LIVE: dict[str, tuple[SparkSession, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="larkspur-")
    return _OWN_DIR["dir"]


def staged_path(spark: SparkSession, name: str) -> str:
    """A new folder of this name. It goes when the application ends, if it wasn't removed before."""
    path = f"{shared_dir(spark)}/larkspur/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def held(df: DataFrame, folder: str) -> DataFrame:
    """df, which reads the folder: once no plan that reads it is left, reap() deletes the folder.

    All plans made from df share one description of its files. The JVM's garbage collector tells when the last of them
    has gone, so a result may be read as often as its owner likes, and is freed without being told.
    """
    spark = df.sparkSession
    for leaf in _leaves(df):
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            files = leaf.relation()
            if any(uuid_of(folder) in str(p) for p in _listed(files.location().rootPaths())):
                _LIVE[folder] = spark, spark._jvm.java.lang.ref.WeakReference(files)
    return df


def uuid_of(folder: str) -> str:
    """The part of a staged folder's name that no other has, however its path is spelt."""
    return folder.rstrip("/").rpartition("-")[2]


def _leaves(df: DataFrame) -> list:
    return _listed(df._jdf.queryExecution().analyzed().collectLeaves())


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def reap(wait: float = 0) -> list[str]:
    """Deletes the staged folders that no plan can read any more, and returns those that are left.

    Every staged() calls it. With wait both garbage collectors run until none is left, or for so many seconds at most:
    Python tells the JVM in its own time which results it has let go.
    """
    until = time.monotonic() + wait
    while True:
        for folder, (spark, files) in list(_LIVE.items()):
            if spark.sparkContext._jsc is None:  # the session has ended, and the folder with it
                del _LIVE[folder]
            elif files.get() is None:
                remove(spark, folder)
        if not _LIVE or time.monotonic() >= until:
            return list(_LIVE)
        gc.collect()
        next(iter(_LIVE.values()))[0]._jvm.java.lang.System.gc()
        time.sleep(0.05)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that survives lost executors.

    The table lives as long as a plan reads it; see held().
    """
    reap()
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    read = held(df.sparkSession.read.schema(df.schema).parquet(path), path)
    read.staged_at = path
    return read


def discard(*tables: DataFrame) -> None:
    """Deletes tables that staged() wrote. What is still to be run must not read them."""
    for df in tables:
        remove(df.sparkSession, df.staged_at)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that staged_path() named."""
    _LIVE.pop(folder, None)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
