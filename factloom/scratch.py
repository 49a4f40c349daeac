"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application's own below spark.checkpoint.dir, deleted when the driver ends.

    Only a local master, whose executors are the driver, may go without that setting: it gets a
    temporary folder. On a cluster a machine's own folder would lose rows, so this raises there.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="factloom-")
        _folders[app] = f"{shared.rstrip('/')}/factloom-{app}-{uuid.uuid4().hex[:8]}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return _folders[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as a table in the shared folder and reads it back.

    Unlike a cached frame the table outlives any executor, and unlike checkpoint() the plan
    runs once. The table stays until `discard`, `release` or the driver's end.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no frame still to be run reads, and finished queries' shuffle files.

    Spark drops shuffle files once the driver's collector finds their queries gone, so it is run.
    """
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
    if tables:
        collect_garbage(tables[0])


def collect_garbage(df: DataFrame) -> None:
    """Has the driver's collector run, after which Spark drops the shuffle files of finished queries."""
    df.sparkSession.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of the application; frames that read them can't be run any more."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        _delete(spark, folder)
