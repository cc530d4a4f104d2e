"""References between version-control objects, parsed from their payloads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.functions.identity import KINDS

# Modes of tree entries. A gitlink names a commit of another repository.
MODES = {"40000": "tree", "100644": "file", "100755": "executable", "120000": "symlink", "160000": "gitlink"}
GITLINK = "160000"
TREE = T.ArrayType(T.StructType([T.StructField("mode", T.StringType()), T.StructField("name", T.BinaryType()), T.StructField("oid", T.BinaryType())]))


def header(payload: Column) -> Column:
    """The lines before the first blank line, bytes as Latin-1."""
    return F.substring_index(F.decode(payload, "ISO-8859-1"), "\n\n", 1)


def _named(payload: Column, field: str, hex_length: int) -> Column:
    """Ids of the header lines of a field; null if one is not hex of the right length."""
    lines = F.filter(F.split(header(payload), "\n"), lambda x: F.startswith(x, F.lit(field + " ")))
    ids = F.transform(lines, lambda x: F.substring(x, len(field) + 2, 1 << 20))
    good = F.forall(ids, lambda i: (F.length(i) == hex_length) & i.rlike(r"^[0-9A-Fa-f]+\z"))
    return F.when(good, F.transform(ids, F.unhex))


def commit_tree(payload: Column, hex_length: int = 40) -> Column:
    """The root tree; null unless there is exactly one."""
    found = _named(payload, "tree", hex_length)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def commit_references(payload: Column, hex_length: int = 40) -> Column:
    """Tree, then parents in their order; null if malformed."""
    tree = commit_tree(payload, hex_length)
    return F.when(tree.isNotNull(), F.concat(F.array(tree), _named(payload, "parent", hex_length)))


def tag_references(payload: Column, hex_length: int = 40) -> Column:
    found = _named(payload, "object", hex_length)
    return F.when(F.size(found) == 1, found)


def entries_of(data: bytes, oid_bytes: int = 20) -> list[dict] | None:
    """Entries of one tree, or None if a byte of it is out of place."""
    out, at = [], 0
    while at < len(data):
        space = data.find(b" ", at, at + 7)
        nul = data.find(b"\0", space + 1) if space > 0 else -1
        mode = data[at:space].decode("latin-1") if nul > 0 else ""
        if mode not in MODES or nul == space + 1 or nul + 1 + oid_bytes > len(data):
            return None
        out.append({"mode": mode, "name": data[space + 1 : nul], "oid": data[nul + 1 : nul + 1 + oid_bytes]})
        at = nul + 1 + oid_bytes
    return out


def tree_entries(payload: Column, oid_bytes: int = 20) -> Column:
    """array<struct<mode, name, oid>> of a tree payload; null if malformed."""

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("mode", pa.string()), ("name", pa.binary()), ("oid", pa.binary())]))
        for batch in batches:
            yield pa.array([None if x is None else entries_of(x, oid_bytes) for x in batch.to_pylist()], kind)

    return F.arrow_udf(parse, TREE)(payload)


def edges(objects: DataFrame, gitlinks: bool = False) -> DataFrame:
    """(src, dst) of objects (oid, kind, data); ``gitlinks`` also follows entries of other repositories."""
    kind = F.col("kind")
    trees = objects.filter(kind == KINDS["tree"]).select("oid", F.explode(tree_entries(F.col("data"))).alias("e"))
    trees = trees if gitlinks else trees.filter(F.col("e.mode") != GITLINK)
    named = objects.filter(kind.isin(KINDS["commit"], KINDS["tag"]))
    ids = F.when(kind == KINDS["commit"], commit_references(F.col("data"))).otherwise(tag_references(F.col("data")))
    out = named.select(F.col("oid").alias("src"), F.explode(ids).alias("dst"))
    return out.unionByName(trees.select(F.col("oid").alias("src"), F.col("e.oid").alias("dst")))


def malformed(objects: DataFrame) -> DataFrame:
    """Commits, trees and tags that can't be parsed."""
    d, kind = F.col("data"), F.col("kind")
    plain = objects.filter(((kind == KINDS["commit"]) & commit_references(d).isNull()) | ((kind == KINDS["tag"]) & tag_references(d).isNull()))
    trees = objects.filter(kind == KINDS["tree"]).withColumn("__e", tree_entries(d)).filter("__e is null").drop("__e")
    return plain.unionByName(trees)
