"""Collection of what nothing refers to: mark, compact, publish, retire.

A mark goes from the roots through alias, location and record to the references
inside each object; a reference without any of the three is an error, and then
there is no result at all.  Retirement waits for pins and readers.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.functions import identity, objects
from strataweave.operators import graph, ordered
from strataweave.session import written
from strataweave.sources import chunks
from strataweave.sources.catalog import Catalog, CatalogError
from strataweave.sources.files import Files

REPO = 16  # bytes of a repository's id
PLACE = ("generation", "chunk_id", "offset", "record_length", "stored_length", "raw_length", "kind", "codec", "flags", "payload_crc32c")


class IntegrityError(ValueError):
    """A reference that leads nowhere."""


def _none(df: DataFrame, what: str) -> None:
    if (bad := df.first()) is not None:
        raise IntegrityError(f"{what}: {bad.asDict()}")


def resolved(aliases: DataFrame, locations: DataFrame, records: DataFrame, domain: str = identity.DOMAIN) -> DataFrame:
    """The written objects that aliases name: node (repository and native id), content_id, kind, data, problem."""
    stored = chunks.records_at(records, locations).select("content_id", "problem", "kind", "codec", "flags", "raw_length", "record.algorithm", "record.oid", "record.payload")
    good = chunks.raw_objects(stored.filter("problem is null"), domain).select("content_id", "kind", F.col("raw").alias("data"), F.col("raw_error").alias("problem"))
    bad = stored.filter("problem is not null").select("content_id", "kind", F.lit(None).cast("binary").alias("data"), "problem")
    node = F.concat("repo_id", "oid").alias("node")
    named = aliases.select(node, "content_id").join(good.unionByName(bad), "content_id", "left")
    return written(named.withColumn("problem", F.when(F.col("kind").isNull(), "no location").otherwise(F.col("problem"))), "resolved")


def live_set(roots: DataFrame, aliases: DataFrame, locations: DataFrame, records: DataFrame, domain: str = identity.DOMAIN, **limits: int) -> DataFrame:
    """The locations of all contents reachable from ``roots`` (repo_id, oid), ascending by content identity."""
    named = resolved(aliases, locations, records, domain)
    sound = named.filter("problem is null")
    links = objects.edges(sound.select(F.col("node").alias("oid"), "kind", "data")).select("src", F.concat(F.substring("src", 1, REPO), "dst").alias("dst"))
    found = graph.mark(written(links, "references"), roots.select(F.concat("repo_id", "oid").alias("node")), **limits)
    reached = found.select("node").join(named, "node", "left")
    _none(reached.filter("content_id is null").select("node"), "a reference has no alias")
    _none(reached.filter("problem is not null").select("node", "problem"), "a reference has no sound record")
    _none(objects.malformed(reached.select(F.col("node").alias("oid"), "kind", "data")).select("oid"), "an object can't be parsed")
    return locations.join(reached.select("content_id").distinct(), "content_id", "left_semi").orderBy("content_id")


def order_faults(listed: DataFrame, position: str, key: str) -> DataFrame:
    """Rows of a list that don't stand strictly above the row before them; lists longer than a task are compared range by range."""
    at = ordered.row_number(listed.select(key, position), [position], "__n")
    prior = at.select((F.col("__n") + 1).alias("__n"), F.col(key).alias("prior"))
    return at.join(prior, "__n").filter(F.col("prior") >= F.col(key)).select(position, key, "prior")


def compacted(live: DataFrame, records: DataFrame, generation: int, target: int) -> tuple[DataFrame, DataFrame]:
    """Locations in the new generation and its sealed files (path, content), records in content order, chunks of about ``target`` bytes."""
    placed = chunks.records_at(records, live)
    _none(placed.filter("problem is not null").select("content_id", "problem"), "a live content has no sound record")
    rows = ordered.running_sum_by_digest(placed.withColumn("__hex", F.lower(F.hex("content_id"))), "__hex", F.col("record_length"), "__before")
    rows = rows.withColumn("chunk_id", F.floor(F.col("__before") / target).cast("long"))
    first = rows.groupBy("chunk_id").agg(F.min("__before").alias("__first"))
    rows = rows.join(first, "chunk_id").withColumns({"generation": F.lit(generation).cast("long"), "offset": F.col("__before") - F.col("__first") + chunks.CHUNK_HEADER})
    rows = written(rows.select("content_id", *PLACE, "record"), "compacted")

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [chunks.Record(r["kind"], r["codec"], r["flags"], r["raw_length"], r["content_id"], r["algorithm"], r["oid"], r["payload"]) for r in table.sort_by("offset").column("record").to_pylist()]
        n = key[0].as_py()
        return pa.table({"path": [f"{generation:010d}/{n:020d}.sealed"], "content": pa.array([chunks.chunk_file(found, generation, n)], pa.binary())})

    return rows.select("content_id", *PLACE), rows.select("chunk_id", "offset", "record").groupBy("chunk_id").applyInArrow(pack, "path string, content binary")


class Generations:
    """Which generation is active, who reads which, and which are being retired, as files."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.files, self.root = Files(spark), root.rstrip("/")

    def active(self) -> int | None:
        found = self.files.read(f"{self.root}/ACTIVE")
        return None if found is None else int.from_bytes(found, "big")

    def activate(self, generation: int) -> None:
        self.files.write(f"{self.root}/ACTIVE", generation.to_bytes(4, "big"))

    def lease(self, generation: int) -> str:
        """A reader's lease; none is given once retirement began, also if it begins meanwhile."""
        name = uuid.uuid4().hex
        self.files.write(f"{self.root}/leases/{generation}/{name}", b"", new=True)
        if self.files.exists(f"{self.root}/retiring/{generation}"):
            self.release(generation, name)
            raise CatalogError(f"generation {generation} is being retired")
        return name

    def release(self, generation: int, name: str) -> None:
        self.files.delete(f"{self.root}/leases/{generation}/{name}")

    def may_reclaim(self, generation: int) -> bool:
        return not self.files.names(f"{self.root}/leases/{generation}")

    def retire(self, generation: int, path: str, trash: str) -> str | None:
        """Close admission, then move the generation's folder away; None while it has readers."""
        if generation == self.active():
            raise CatalogError("the active generation can't be retired")
        self.files.write(f"{self.root}/retiring/{generation}", b"")
        if not self.may_reclaim(generation):
            return None
        to = f"{trash}/{generation}-{uuid.uuid4().hex}"
        if self.files.exists(path):
            self.files.move(path, to)
        return to

    def drop_abandoned(self) -> int:
        """At startup nobody reads: all leases go."""
        found = [(g, n) for g in self.files.names(f"{self.root}/leases") for n in self.files.names(f"{self.root}/leases/{g}")]
        for g, n in found:
            self.files.delete(f"{self.root}/leases/{g}/{n}")
        return len(found)

    def reconcile(self, catalog: Catalog) -> int | None:
        """The catalog decides which generation is active."""
        row = catalog.read("meta").filter("key = 'current_generation'").first()
        if row is None:
            return None
        generation = int.from_bytes(bytes(row.value), "big")
        if generation != self.active():
            self.activate(generation)
        return generation


def retire_compacted(catalog: Catalog, generations: Generations, source: int, path: str, trash: str) -> str:
    """``deferred_by_pin``, ``deferred_by_reader`` or ``retired``."""
    if not catalog.may_retire(source):
        return "deferred_by_pin"
    return "retired" if generations.retire(source, path, trash) else "deferred_by_reader"


def run_gc(catalog: Catalog, generations: Generations, records: DataFrame, roots: DataFrame, root: str, source: int, target: int, chunk_bytes: int = 1 << 30, domain: str = identity.DOMAIN, **limits: int) -> dict:
    """One collection: the live contents of generation ``source`` move to ``target``, which becomes current; then the source goes if nothing holds it."""
    if target <= source or generations.active() != source:
        raise CatalogError("the target must be newer than the source, and the source active")
    locations = catalog.read("object_locations")
    live = written(live_set(roots, catalog.read("oid_aliases"), locations, records, domain, **limits), "live")
    moved, made = compacted(live, records, target, chunk_bytes)
    made = written(made, "compacted-files")
    for row in made.toLocalIterator():  # one bounded file at a time
        generations.files.write(f"{root}/{row.path}", bytes(row.content), new=True)
    _none(chunks.reports(made, domain).filter("action <> 'none'").select("path", "error"), "a written chunk is not whole")
    before, after = locations.count(), moved.count()
    catalog.publish_generation(target, moved)
    generations.activate(target)
    return {"live": after, "dropped": before - after, "source": retire_compacted(catalog, generations, source, f"{root}/{source:010d}", f"{root}/trash")}
