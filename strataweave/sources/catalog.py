"""A catalog of keyed tables with atomic commits over several tables.

Every commit writes the tables it changes into a new version folder, validates
all of them, and then moves one numbered pointer file to where none is.  Of two
writers that read the same version only one gets the next number.  Readers take
the highest number once, so they see a whole commit or none; a failed commit
leaves an unreferenced folder.  Works on any Hadoop store whose rename of a file
fails if the target is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.sources.files import Files

# Tables, their columns and keys.
TABLES = {
    "object_locations": ("content_id binary, generation long, chunk_id long, offset long, record_length long, stored_length long, raw_length long, kind int, codec int, flags int, payload_crc32c long", ["content_id"]),
    "oid_aliases": ("repo_id binary, algo int, oid binary, content_id binary", ["repo_id", "algo", "oid"]),
    "repositories": ("repo_id binary, record binary", ["repo_id"]),
    "repo_snapshots": ("repo_id binary, snapshot_id binary, visibility int", ["repo_id", "snapshot_id"]),
    "chunks": ("generation long, chunk_id long, state int, size long, record_count long", ["generation", "chunk_id"]),
    "workspaces": ("workspace_id binary, record binary", ["workspace_id"]),
    "workspace_names": ("name string, workspace_id binary", ["name"]),
    "pins": ("kind int, id binary, generation long", ["kind", "id"]),
    "jobs": ("job_id binary, kind binary, payload binary, state int, attempts long, last_error binary", ["job_id"]),
    "meta": ("key string, value binary", ["key"]),
}
READY, INCOMPLETE = 2, 1
WORKSPACE_PIN, EXPLICIT_PIN = 0, 1


class CatalogError(ValueError):
    """A commit that breaks a rule; nothing of it is visible."""


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark)

    def _commits(self) -> list[str]:
        return [n for n in self.files.names(f"{self.root}/commits") if not n.startswith(".")]

    def _pointer(self) -> dict[str, str]:
        """Where each table is at the last commit; its number is under ``#``."""
        found = self._commits()
        return json.loads(self.files.read(f"{self.root}/commits/{found[-1]}")) if found else {}

    def read(self, table: str, pointer: dict | None = None) -> DataFrame:
        """The table at the version the pointer names now."""
        schema = TABLES[table][0]
        where = (self._pointer() if pointer is None else pointer).get(table)
        return self.spark.read.schema(schema).parquet(where) if where else self.spark.createDataFrame([], schema)

    def apply(self, put: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Upserts, deletes by key and whole replacements of several tables, all or nothing.

        An alias that exists keeps its content: putting it again unchanged is
        fine, another content rejects the commit.
        """
        put, delete, replace = put or {}, delete or {}, replace or {}
        pointer, version = self._pointer(), uuid.uuid4().hex
        after = dict(pointer)
        for table in {*put, *delete, *replace}:
            schema, key = TABLES[table]
            names = [f.name for f in self.spark.createDataFrame([], schema).schema]
            now = replace[table].select(names) if table in replace else self.read(table, pointer)
            if table in delete:
                now = now.join(delete[table].select(key), key, "left_anti")
            if table in put:
                new = put[table].select(names).distinct()
                if not new.groupBy(key).count().filter("count > 1").isEmpty():
                    raise CatalogError(f"{table}: a key is put twice with different values")
                if table == "oid_aliases":
                    old = now.select(*key, F.col("content_id").alias("__old"))
                    if not new.join(old, key).filter("content_id <> __old").isEmpty():
                        raise CatalogError("an alias already names another content")
                now = now.join(new.select(key), key, "left_anti").select(names).unionByName(new)
            after[table] = f"{self.root}/{table}/{version}"
            now.select(names).write.parquet(after[table])
        after["#"] = pointer.get("#", 0) + 1
        try:
            self.files.write(f"{self.root}/commits/{after['#']:020d}", json.dumps(after).encode(), new=True)
        except FileExistsError as first:
            raise CatalogError("another commit came first") from first

    def validate(self) -> None:
        """Keys are unique and not null in every table."""
        pointer = self._pointer()
        for table, (_, key) in TABLES.items():
            df = self.read(table, pointer)
            bad = F.lit(False)
            for c in key:
                bad = bad | F.col(c).isNull()
            if not df.filter(bad).isEmpty() or not df.groupBy(key).count().filter("count > 1").isEmpty():
                raise CatalogError(f"{table}: a key is null or repeated")

    # ---- operations over the tables

    def import_objects(self, objects: DataFrame) -> dict[str, int]:
        """Dedup insert of (repo_id, algo, oid, content_id and the location's columns): new contents once, aliases always."""
        names = [c.split()[0] for c in TABLES["object_locations"][0].split(", ")]
        first = objects.groupBy("content_id").agg(F.min(F.struct(*names[1:])).alias("l")).select("content_id", "l.*")
        new = first.join(self.read("object_locations").select("content_id"), "content_id", "left_anti")
        seen, written_ = objects.select("repo_id", "algo", "oid").distinct().count(), new.count()
        self.apply(put={"object_locations": new, "oid_aliases": objects})
        return {"objects_seen": seen, "objects_written": written_, "objects_deduplicated": seen - written_}

    def gc_roots(self) -> DataFrame:
        """Ready snapshots, workspace pins, explicit pins, in this order and by id."""
        none = F.lit(None)
        ready = self.read("repo_snapshots").filter(F.col("visibility") == READY).select(F.lit(0).alias("root_order"), F.lit("snapshot").alias("root_kind"), "repo_id", F.col("snapshot_id").alias("id"), none.cast("long").alias("generation"))
        pins = self.read("pins").select((F.col("kind") + 1).alias("root_order"), F.when(F.col("kind") == WORKSPACE_PIN, "workspace_pin").otherwise("explicit_pin").alias("root_kind"), none.cast("binary").alias("repo_id"), "id", "generation")
        return ready.unionByName(pins).orderBy("root_order", "repo_id", "id")

    def delete_repository(self, repo_id: bytes) -> None:
        """The repository and its snapshots; aliases stay, as deduplication depends on them."""
        gone = self.spark.createDataFrame([(repo_id,)], "repo_id binary")
        snapshots = self.read("repo_snapshots").join(gone, "repo_id")
        self.apply(delete={"repositories": gone, "repo_snapshots": snapshots})

    def persist_workspace(self, workspace_id: bytes, name: str, record: bytes, generation: int) -> None:
        """Record, name and pin in one commit; repeating it is fine, taking another's name is not."""
        owner = self.read("workspace_names").filter(F.col("name") == name).first()
        if owner and bytes(owner.workspace_id) != workspace_id:
            raise CatalogError("the name belongs to another workspace")
        row = lambda table, *v: self.spark.createDataFrame([v], TABLES[table][0])
        self.apply(put={"workspaces": row("workspaces", workspace_id, record), "workspace_names": row("workspace_names", name, workspace_id), "pins": row("pins", WORKSPACE_PIN, workspace_id, generation)})

    def publish_generation(self, generation: int, locations: DataFrame) -> None:
        """The new generation's locations are all there are, and it is current, in one commit."""
        current = self.spark.createDataFrame([("current_generation", generation.to_bytes(4, "big"))], TABLES["meta"][0])
        self.apply(put={"meta": current}, replace={"object_locations": locations})

    def may_retire(self, generation: int) -> bool:
        """Whether no pin holds the generation."""
        return self.read("pins").filter(F.col("generation") == generation).isEmpty()
