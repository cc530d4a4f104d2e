"""Session and shared-storage helpers used by every subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_SCRATCH: list[str] = []
_PATH = "_strataweave_path"


def get_spark(app: str = "strataweave", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark only, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the cluster sets it.  Only a local
    master, where driver and executors are one process, may fall back to a
    temporary folder; on a cluster a missing setting is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="strataweave-"))
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[0], ignore_errors=True)
    return "file://" + _LOCAL_SCRATCH[0]


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and values that depend on how rows were dealt to tasks are fixed by the
    commit.  Parquet with zstd keeps the copy smaller than ``checkpoint()``.
    ``by`` names a column of few values, each of which gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")  # the job's shuffle files go as soon as its table is committed
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__[_PATH] = path
    return out


def forget(df: DataFrame, part: str | None = None) -> None:
    """Delete the folder of a table that ``written`` returned, or the part of it (``column=value``) that it was written by.

    Call it only when nothing that still has to run depends on it.
    """
    path = df.__dict__.get(_PATH)
    if path and part:
        _delete(df.sparkSession, f"{path}/{part}")
    elif path:
        del df.__dict__[_PATH]
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
