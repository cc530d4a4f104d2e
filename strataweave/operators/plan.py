"""Checkout plans: directories, duplicates and conflicts of path entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import paths


def directories(plan: DataFrame) -> DataFrame:
    """Distinct strict parents of all entries (path arrays)."""
    return plan.select(F.explode(paths.parents(F.col("path"))).alias("path")).distinct()


def duplicates(plan: DataFrame) -> DataFrame:
    return plan.groupBy("path").agg(F.count("*").alias("entries")).filter("entries > 1")


def conflicts(plan: DataFrame) -> DataFrame:
    """Entries that are an ancestor of another entry: an equi-join with the exploded parents, not a theta join."""
    return plan.select("path").distinct().join(directories(plan), "path", "left_semi")


def validated(plan: DataFrame, limit: int = paths.MAX_ENTRIES) -> DataFrame:
    """The plan, or an error naming the first thing that is wrong with it."""
    if plan.count() > limit:
        raise ValueError(f"a plan has at most {limit} entries")
    for what, bad in (("path twice", duplicates(plan)), ("file that is also a directory", conflicts(plan))):
        row = bad.first()
        if row:
            raise ValueError(f"{what}: {'/'.join(row['path'])}")
    return plan
