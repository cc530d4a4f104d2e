"""A cache of raw blobs at ``aa/bb/<64 hex>`` below a folder of any Hadoop store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.operators import cache
from strataweave.sources import chunks
from strataweave.sources.files import Files

_LEAF = r"^([0-9a-f]{2})/([0-9a-f]{2})/(\1\2[0-9a-f]{60})$"
QUARANTINE = ".quarantine"


class CacheStore:
    """Listing and hashing are Spark's; only what is published, evicted or quarantined goes through the driver, file by file.

    Spark's file scan leaves out files of no bytes, so the empty blob is no entry.
    """

    def __init__(self, spark: SparkSession, root: str, domain: str = identity.DOMAIN) -> None:
        self.spark, self.root, self.domain, self.files = spark, root.rstrip("/"), domain, Files(spark)
        self.files.make_folder(self.root)

    def _listed(self) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        base = self.root.split("://")[-1].rstrip("/") + "/"
        out = found.withColumn("relative", F.substring_index("path", base, -1)).filter(~F.startswith("relative", F.lit(QUARANTINE + "/")))
        return out.withColumn("cid", F.when(F.col("relative").rlike(_LEAF), F.substring_index("relative", "/", -1)))

    def entries(self) -> DataFrame:
        """cid (hex) and logical_bytes of the canonical leaves, by identity."""
        return self._listed().filter("cid is not null").select("cid", F.col("length").alias("logical_bytes")).orderBy("cid")

    def usage(self) -> DataFrame:
        """entries, logical_bytes and the files skipped, as they are no entries."""
        entry = F.col("cid").isNotNull()
        return self._listed().agg(F.count_if(entry).alias("entries"), F.coalesce(F.sum(F.when(entry, F.col("length"))), F.lit(0)).alias("logical_bytes"), F.count_if(~entry).alias("skipped"))

    def reconcile(self) -> dict[str, int]:
        """Hash every leaf again; those that aren't what they are named after go to quarantine."""
        listed = self._listed().withColumn("own", identity.content_id(F.col("content"), domain=self.domain))
        state = F.when(F.col("cid").isNull(), "skipped").when(F.col("cid") == F.col("own"), "retained").otherwise("quarantined")
        rows = listed.select("relative", state.alias("state"))
        out = {"retained": 0, "quarantined": 0, "skipped": 0} | {r.state: r["count"] for r in rows.groupBy("state").count().collect()}
        for r in rows.filter("state = 'quarantined'").select("relative").toLocalIterator() if out["quarantined"] else ():
            self.files.move(f"{self.root}/{r.relative}", f"{self.root}/{QUARANTINE}/{uuid.uuid4().hex}")
        return out

    def path(self, cid: str) -> str:
        return f"{self.root}/{cid[:2]}/{cid[2:4]}/{cid}"

    def publish(self, cid: str, raw: bytes) -> str:
        """One blob, its identity checked; where it is already, what is there is checked."""
        if chunks.content_digest(identity.KINDS["blob"], raw, self.domain).hex() != cid:
            raise chunks.FormatError("content id")
        try:
            self.files.write(self.path(cid), raw, new=True)
        except FileExistsError:
            if self.files.read(self.path(cid), 1 << 31) != raw:
                raise chunks.FormatError("another blob is there") from None
        return self.path(cid)

    def hydrate(self, needed: DataFrame, locations: DataFrame, records: DataFrame) -> int:
        """Decode and publish the contents (content_id) that aren't cached, each once however often it is asked for; how many were. A miss without a sound record is an error."""
        have = self.entries().select(F.unhex("cid").alias("content_id"))
        missing = needed.select("content_id").distinct().join(have, "content_id", "left_anti")
        placed = chunks.records_at(records, missing.join(locations, "content_id", "left"))
        bad = placed.filter("problem is not null").select("content_id", "problem").first()
        if bad is not None:
            raise chunks.FormatError(f"{bytes(bad.content_id).hex()}: {bad.problem}")
        found = chunks.raw_objects(placed.select("record.*"), self.domain)
        n = 0
        for r in found.select("content_id", "raw", "raw_error").toLocalIterator():
            if r.raw_error:
                raise chunks.FormatError(r.raw_error)
            self.publish(bytes(r.content_id).hex(), bytes(r.raw))
            n += 1
        return n

    def evict_to(self, target: int) -> dict[str, int | bool]:
        """Evict in digest order until the rest is within ``target``."""
        before = self.usage().first()
        n = size = 0
        for r in cache.evict_to(self.entries(), target).toLocalIterator():
            n, size = n + self.files.delete(self.path(r.cid)), size + r.logical_bytes
        after = before.logical_bytes - size
        return {"before": before.logical_bytes, "after": after, "evicted_entries": n, "evicted_logical_bytes": size, "target_reached": after <= target}
