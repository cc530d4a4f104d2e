"""Path predicates over component arrays.

Components compare one by one, so ``a/b`` stands before ``a-`` whatever the
bytes of the joined text say; arrays of binary order like that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of a checkout plan.
MAX_NAME, MAX_PATH, MAX_COMPONENTS, MAX_ENTRIES = 255, 4096, 128, 1_000_000


def name_error(name: Column) -> Column:
    """The first rule a name breaks, or null."""
    return (
        F.when(name == "", "empty_name").when(F.contains(name, F.lit("\x00")), "nul").when(F.contains(name, F.lit("/")), "separator")
        .when(name.isin(".", ".."), "dot_name").when(F.octet_length(name) > MAX_NAME, "long_name")
    )


def path_error(path: Column) -> Column:
    """``ok`` or the first rule a relative path breaks."""
    parts = F.split(path, "/", -1)
    bad = F.filter(F.transform(parts, name_error), lambda e: e.isNotNull())
    return (
        F.when(path == "", "empty").when(F.startswith(path, F.lit("/")), "absolute").when(F.octet_length(path) > MAX_PATH, "long_path")
        .when(F.size(parts) > MAX_COMPONENTS, "deep").when(F.size(bad) > 0, bad[0]).otherwise("ok")
    )


def parents(components: Column) -> Column:
    """All strict prefixes of a component array, shortest first."""
    n = F.size(components)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.slice(components, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether ``a`` is a strict component prefix of ``b``."""
    return (F.size(a) < F.size(b)) & (F.slice(b, F.lit(1), F.size(a)) == a)


def overlaps(a: Column, b: Column) -> Column:
    """Whether one path is the other or an ancestor of it."""
    return (a == b) | is_ancestor(a, b) | is_ancestor(b, a)
