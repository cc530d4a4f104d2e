"""Reachability, marking and hierarchy expansion over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import written

# Limits of a mark.
MAX_ROOTS, MAX_REFERENCES, MAX_OBJECTS = 4_096, 16_777_216, 8_388_608
#: No limits: for a mark that is to be whole however large it is.
UNBOUNDED = {"max_roots": None, "max_references": None, "max_objects": None}


def reachable(edges: DataFrame, roots: DataFrame, levels: int | None = None) -> DataFrame:
    """(node, level): every node reachable from ``roots`` (node), each once, at its first level.

    ``edges`` has src and dst.  A level is a join of the frontier with the
    edges and an anti-join with what was visited, both shuffled, written to the
    shared folder; shared subgraphs are walked once and cycles end.
    """
    frontier = written(roots.select("node").distinct().withColumn("level", F.lit(0)), "frontier")
    visited, level = frontier, 0
    while (levels is None or level < levels) and not frontier.isEmpty():
        level += 1
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        nxt = nxt.join(visited.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        frontier = written(nxt, "frontier")
        visited = visited.unionByName(frontier)
    return visited


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is not a known node: a non-empty result is an integrity error."""
    return edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti")


def mark(edges: DataFrame, roots: DataFrame, max_roots: int | None = MAX_ROOTS, max_references: int | None = MAX_REFERENCES, max_objects: int | None = MAX_OBJECTS) -> DataFrame:
    """The reachable nodes, or an error with no partial result when a limit is passed.

    References count as they are queued: the roots, and all edges out of
    marked nodes, repeated ones too.  The limits are what one process may hold
    in a collection; a mark is tables here and needs none, so each may be None.
    """
    found = reachable(edges, roots)
    limits = {"roots": max_roots, "references": max_references, "objects": max_objects}
    if all(most is None for most in limits.values()):
        return found
    found = written(found, "marked")
    told = totals(edges, roots, found).first()
    for name, most in limits.items():
        if most is not None and told[name] > most:
            raise ValueError(f"mark has {told[name]} {name}; the limit is {most}")
    return found


def totals(edges: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """One row: roots, references and objects of a mark."""
    out = edges.join(found.select(F.col("node").alias("src")), "src", "left_semi").agg(F.count("*").alias("e"))
    r, o = roots.agg(F.count("*").alias("roots")), found.agg(F.count("*").alias("objects"))
    return r.crossJoin(o).crossJoin(out).select("roots", (F.col("roots") + F.col("e")).alias("references"), "objects")  # one row each


def expand(entries: DataFrame, roots: DataFrame, max_depth: int = 128) -> DataFrame:
    """Leaves below ``roots`` (node) as (path array, mode, node).

    ``entries`` has src, name, mode, dst; mode ``tree`` goes on.  The same
    subtree in two places is expanded twice; a tree on its own path, or one
    deeper than ``max_depth``, is an error.
    """
    now = roots.select("node", F.array().cast("array<string>").alias("path"), F.array("node").alias("above"))
    leaves = None
    for _ in range(max_depth):
        step = now.join(entries, F.col("node") == F.col("src"))
        step = step.select("dst", "mode", F.concat("path", F.array("name")).alias("path"), "above", F.array_contains("above", F.col("dst")).alias("cycle"))
        step = written(step, "expanded")
        found = step.filter("mode <> 'tree'").select("path", "mode", F.col("dst").alias("node"))
        leaves = found if leaves is None else leaves.unionByName(found)
        trees = step.filter("mode = 'tree'")
        if not trees.filter("cycle").isEmpty():
            raise ValueError("a tree contains itself")
        if trees.isEmpty():
            return leaves
        now = trees.select(F.col("dst").alias("node"), "path", F.concat("above", F.array("dst")).alias("above"))
    raise ValueError(f"a tree is deeper than {max_depth}")
