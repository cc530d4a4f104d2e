"""Checkout of a commit: plan, materialize into a staging folder, publish by moving it.

The plan is a table; blobs are decoded by the executors and written by the driver
one after another, as a checkout is one folder of one machine.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import identity, objects
from strataweave.functions.paths import MAX_COMPONENTS, MAX_ENTRIES, path_error
from strataweave.operators import graph
from strataweave.session import written
from strataweave.sources import manifests
from strataweave.sources.catalog import Catalog, CatalogError
from strataweave.sources.files import Files


class CheckoutError(ValueError):
    """A plan or a folder that breaks a rule; nothing is published."""


def plan_commit(found: DataFrame, commit: bytes, max_entries: int = MAX_ENTRIES, max_depth: int = MAX_COMPONENTS) -> DataFrame:
    """The written plan of a commit: path, mode, oid of each leaf, from objects (oid, kind, data)."""
    root = found.filter((F.col("oid") == F.lit(bytearray(commit))) & (F.col("kind") == identity.KINDS["commit"])).select(objects.commit_tree(F.col("data"), 2 * len(commit)).alias("node"))
    if (row := root.first()) is None or row.node is None:
        raise CheckoutError("no such commit, or it names no tree")
    trees = found.filter(F.col("kind") == identity.KINDS["tree"]).select(F.col("oid").alias("src"), F.explode(objects.tree_entries(F.col("data"), len(commit))).alias("e"))
    # names are bytes; Latin-1 keeps every one of them, and their order
    entries = trees.select("src", F.decode("e.name", "ISO-8859-1").alias("name"), F.when(F.col("e.mode") == "40000", "tree").otherwise(F.col("e.mode")).alias("mode"), F.col("e.oid").alias("dst"))
    entries = written(entries, "tree-entries")
    reached = graph.reachable(entries.filter("mode = 'tree'").select("src", "dst"), root)
    if not reached.join(found.select(F.col("oid").alias("node")), "node", "left_anti").isEmpty():
        raise CheckoutError("a tree is missing")
    leaves = graph.expand(entries, root, max_depth)
    out = written(leaves.select(F.array_join("path", "/").alias("path"), "mode", F.col("node").alias("oid")), "checkout-plan")
    bad = out.withColumn("why", path_error(F.col("path"))).filter("why <> 'ok'").first()
    if bad is not None:
        raise CheckoutError(f"{bad.path!r}: {bad.why}")
    if out.count() > max_entries:
        raise CheckoutError(f"more than {max_entries} entries")
    if not out.groupBy("path").count().filter("count > 1").isEmpty():
        raise CheckoutError("a path is there twice")
    return out


def counters(entries: DataFrame) -> dict[str, int]:
    """The counts of a workspace manifest: directories and entries by mode; all regular files are copies."""
    by = {r.mode: r["count"] for r in entries.groupBy("mode").count().collect()}
    folders = entries.select(F.explode(plan_parents(F.col("path"))).alias("d")).distinct().count()
    regular, executable = by.get("100644", 0), by.get("100755", 0)
    return {"directories": folders, "regular_files": regular, "executable_files": executable, "symlinks": by.get("120000", 0), "gitlinks": by.get("160000", 0), "reflinked_regular_files": 0, "copied_regular_files": regular + executable}


def plan_parents(path):
    """The folders above a path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def _bytes(path: str) -> bytes:
    return path.encode("latin-1")


def materialize(entries: DataFrame, blobs: DataFrame, staging: str, gitlinks: str = "directory") -> int:
    """Write the plan into an empty local folder from blobs (oid, data); how many entries. ``gitlinks``: ``directory`` or ``reject``."""
    top = os.fsencode(staging)
    os.makedirs(top, exist_ok=True)
    if os.listdir(top):
        raise CheckoutError("the staging folder is not empty")
    rows = entries.join(blobs.select("oid", "data"), "oid", "left")
    n = 0
    for r in rows.select("path", "mode", "data").toLocalIterator():
        at = os.path.join(top, _bytes(r.path))
        os.makedirs(os.path.dirname(at), exist_ok=True)
        if r.mode == "160000":
            if gitlinks == "reject":
                raise CheckoutError(f"{r.path!r} is another repository's")
            os.makedirs(at)
        elif r.data is None:
            raise CheckoutError(f"{r.path!r}: its blob is missing")
        elif r.mode == "120000":
            os.symlink(bytes(r.data), at)
        else:
            with open(os.open(at, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o755 if r.mode == "100755" else 0o644), "wb") as out:
                out.write(bytes(r.data))
        n += 1
    return n


def publish(staging: str, workspaces: str, trash: str, name: str, replace: bool = False) -> str:
    """Move the staged folder to its name; with ``replace`` what is there goes to the trash first."""
    if not re.fullmatch(manifests.WORKSPACE_NAME, name):
        raise CheckoutError("not a workspace's name")
    to = os.path.join(workspaces, name)
    os.makedirs(workspaces, exist_ok=True)
    if os.path.lexists(to):
        if not replace:
            raise CheckoutError("the workspace is there already")
        withdraw(workspaces, trash, name)
    os.rename(staging, to)
    return to


def withdraw(workspaces: str, trash: str, name: str) -> str | None:
    """Move a workspace to the trash; None where there is none."""
    at = os.path.join(workspaces, name)
    if not os.path.lexists(at):
        return None
    os.makedirs(trash, exist_ok=True)
    to = os.path.join(trash, f"{name}-{uuid.uuid4().hex}")
    os.rename(at, to)
    return to


def manifest_path(root: str, workspace_id: bytes) -> str:
    return f"{root}/{workspace_id.hex()}"


def checkout_and_persist(catalog: Catalog, found: DataFrame, request: dict, folders: dict[str, str], replace: bool = False, gitlinks: str = "directory") -> str:
    """Plan, materialize, write the manifest, publish the folder, then record, name and pin in one commit; what fails before that commit is withdrawn.

    ``request`` has workspace_id, repository, snapshot_id, commit, generation, name
    and created_unix_secs; ``folders`` has staging, workspaces, trash (local) and
    manifests (any store).
    """
    entries = plan_commit(found, request["commit"])
    manifest = request | {"algorithm": 1 if len(request["commit"]) == 20 else 2, "name": request["name"].encode(), "optional_fields": [], **counters(entries)}
    record, files = manifests.WORKSPACE.encode(manifest), Files(catalog.spark)
    staging = os.path.join(folders["staging"], uuid.uuid4().hex)
    materialize(entries, found.filter(F.col("kind") == identity.KINDS["blob"]), staging, gitlinks)
    at = manifest_path(folders["manifests"], request["workspace_id"])
    manifests.ensure_file(catalog.spark, at, manifests.WORKSPACE, manifest)
    out = publish(staging, folders["workspaces"], folders["trash"], request["name"], replace)
    try:
        catalog.persist_workspace(request["workspace_id"], request["name"], record, request["generation"])
    except CatalogError:
        withdraw(folders["workspaces"], folders["trash"], request["name"])
        files.delete(at)
        raise
    return out


def ready(catalog: Catalog, root: str, workspace_id: bytes) -> dict | None:
    """The manifest, if the record, its name and its pin agree with it; None if any is missing."""
    manifest = manifests.read_file(catalog.spark, manifest_path(root, workspace_id), manifests.WORKSPACE)
    key = F.lit(bytearray(workspace_id))
    record = catalog.read("workspaces").filter(F.col("workspace_id") == key).first()
    name = catalog.read("workspace_names").filter(F.col("workspace_id") == key).first()
    pin = catalog.read("pins").filter((F.col("id") == key) & (F.col("kind") == 0)).first()
    if None in (manifest, record, name, pin):
        return None
    if bytes(record.record) != manifests.WORKSPACE.encode(manifest) or name.name.encode() != manifest["name"] or pin.generation != manifest["generation"]:
        raise CatalogError("the workspace's record, name or pin disagrees with its manifest")
    return manifest


def reconcile(catalog: Catalog, folders: dict[str, str], most: int = 4096) -> dict[str, int]:
    """At startup: workspaces whose manifest is there but that are not ready are withdrawn."""
    names = Files(catalog.spark).names(folders["manifests"])
    if len(names) > most:
        raise CheckoutError(f"more than {most} manifests")
    out = {"ready": 0, "withdrawn": 0}
    for name in names:
        workspace_id = bytes.fromhex(name)
        if ready(catalog, folders["manifests"], workspace_id):
            out["ready"] += 1
            continue
        manifest = manifests.read_file(catalog.spark, manifest_path(folders["manifests"], workspace_id), manifests.WORKSPACE)
        withdraw(folders["workspaces"], folders["trash"], manifest["name"].decode())
        out["withdrawn"] += 1
    return out


def delete(catalog: Catalog, folders: dict[str, str], workspace_id: bytes) -> None:
    """Withdraw the folder, drop the pin, remove the manifest; the record and the name stay."""
    manifest = ready(catalog, folders["manifests"], workspace_id)
    if manifest is None:
        raise CheckoutError("the workspace is not ready")
    withdraw(folders["workspaces"], folders["trash"], manifest["name"].decode())
    catalog.apply(delete={"pins": catalog.read("pins").filter((F.col("id") == F.lit(bytearray(workspace_id))) & (F.col("kind") == 0))})
    Files(catalog.spark).delete(manifest_path(folders["manifests"], workspace_id))
