"""Snapshots become visible in three steps: incomplete, manifest durable, ready.

Whatever step a process stops after, ``reconcile`` finishes what has its
manifest and leaves the rest invisible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.sources import manifests
from strataweave.sources.catalog import INCOMPLETE, READY, TABLES, Catalog, CatalogError


def _visibility(catalog: Catalog, repository: bytes, snapshot: bytes) -> int | None:
    found = catalog.read("repo_snapshots").filter((F.col("repo_id") == F.lit(bytearray(repository))) & (F.col("snapshot_id") == F.lit(bytearray(snapshot)))).first()
    return found.visibility if found else None


def _put(catalog: Catalog, repository: bytes, snapshot: bytes, visibility: int) -> None:
    row = catalog.spark.createDataFrame([(bytearray(repository), bytearray(snapshot), visibility)], TABLES["repo_snapshots"][0])
    catalog.apply(put={"repo_snapshots": row})


def begin(catalog: Catalog, manifest: dict) -> None:
    """The snapshot is incomplete; beginning again is fine until it is ready."""
    manifests.SNAPSHOT.encode(manifest)
    now = _visibility(catalog, manifest["repository"], manifest["snapshot_id"])
    if now == READY:
        raise CatalogError("the snapshot is ready already")
    if now is None:
        _put(catalog, manifest["repository"], manifest["snapshot_id"], INCOMPLETE)


def finish(catalog: Catalog, path: str, manifest: dict) -> str:
    """Ready, if the manifest file says what was meant."""
    if manifests.read_file(catalog.spark, path, manifests.SNAPSHOT) != manifest:
        raise CatalogError("the manifest that is there is another one")
    return reconcile(catalog, path)


def publish(catalog: Catalog, path: str, manifest: dict) -> str:
    """All three steps."""
    begin(catalog, manifest)
    manifests.write_file(catalog.spark, path, manifests.SNAPSHOT, manifest)
    return finish(catalog, path, manifest)


def reconcile(catalog: Catalog, path: str) -> str:
    """``published``, ``already_ready`` or ``not_begun``, from the manifest file alone."""
    manifest = manifests.read_file(catalog.spark, path, manifests.SNAPSHOT)
    if manifest is None:
        return "no_manifest"
    now = _visibility(catalog, manifest["repository"], manifest["snapshot_id"])
    if now is None:
        return "not_begun"
    if now == READY:
        return "already_ready"
    _put(catalog, manifest["repository"], manifest["snapshot_id"], READY)
    return "published"


def promoted(snapshots: DataFrame, read: DataFrame) -> DataFrame:
    """repo_id, snapshot_id of the incomplete snapshots whose manifest (value, error) was read whole."""
    whole = read.filter("error is null").select(F.col("value.repository").alias("repo_id"), F.col("value.snapshot_id").alias("snapshot_id")).distinct()
    return snapshots.filter(F.col("visibility") == INCOMPLETE).select("repo_id", "snapshot_id").join(whole, ["repo_id", "snapshot_id"], "left_semi")


def reconcile_all(catalog: Catalog, folder: str) -> DataFrame:
    """At startup: every incomplete snapshot whose manifest is whole becomes ready, in one commit; the rows that did."""
    spark: SparkSession = catalog.spark
    done = promoted(catalog.read("repo_snapshots"), manifests.read_files(spark, folder, manifests.SNAPSHOT))
    rows = done.withColumn("visibility", F.lit(READY)).collect()  # what stopped between two steps
    out = spark.createDataFrame(rows, TABLES["repo_snapshots"][0])
    if rows:
        catalog.apply(put={"repo_snapshots": out})
    return out
