"""Backup inventories: verification against files, ordered descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inventory(spark, root: str) -> DataFrame:
    """relative, bytes, sha256 of every file below a folder of any Hadoop store.

    Spark's file scan leaves out files of no bytes, so those come from a listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    rows = files.select(F.substring_index("path", base, -1).alias("relative"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    empty = []
    while listed.hasNext():
        f = listed.next()
        if f.getLen() == 0:
            empty.append((f.getPath().toString().split(base, 1)[1],))
    nothing = spark.createDataFrame(empty, "relative string").withColumns({"bytes": F.lit(0).cast("long"), "sha256": F.sha2(F.lit(b""), 256)})
    return rows.unionByName(nothing)


def mismatches(manifest: DataFrame, files: DataFrame, key: str = "relative") -> DataFrame:
    """Manifest rows whose file is missing or differs; files that the manifest doesn't list are ignored."""
    f = files.select(F.col(key).alias("__k"), F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha"))
    out = manifest.join(f, F.col(key) == F.col("__k"), "left")
    what = F.when(F.col("__k").isNull(), "missing").when(~F.col("bytes").eqNullSafe(F.col("__bytes")), "length").when(~F.col("sha256").eqNullSafe(F.col("__sha")), "digest")
    return out.withColumn("problem", what).filter("problem is not null").drop("__k", "__bytes", "__sha")


def order_violations(df: DataFrame, position: str, *key: str, by: str) -> DataFrame:
    """Rows whose key is not above that of the row before, within each manifest ``by``; rows at one position stand in key order."""
    w = Window.partitionBy(by).orderBy(position, *key)
    prior = F.lag(F.struct(*key)).over(w)
    return df.withColumn("__prior", prior).filter(F.col("__prior") >= F.struct(*key)).drop("__prior")


def layout_mismatches(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Identities that only one of two layouts has."""
    a = left.select(*key, F.lit(True).alias("__a"))
    out = a.join(right.select(*key, F.lit(True).alias("__b")), key, "full_outer")
    return out.select(*key, F.col("__a").isNotNull().alias("in_left"), F.col("__b").isNotNull().alias("in_right")).filter("not (in_left and in_right)")


def ready_workspaces(records: DataFrame, manifests: DataFrame, names: DataFrame, pins: DataFrame, key: str = "workspace_id") -> DataFrame:
    """Workspaces on which the record, the manifest, the name and the pin agree."""
    return records.join(manifests, key).filter(F.col("record_digest") == F.col("manifest_digest")).join(names, [key, "name"]).join(pins, [key, "generation"])
