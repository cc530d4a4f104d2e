"""Cache accounting: usage, deterministic eviction and capacity admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators import ordered


def usage(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("logical_bytes"), F.lit(0)).alias("logical_bytes"))


def evict_to(entries: DataFrame, target: int) -> DataFrame:
    """The entries to evict, in digest order, until what is left is within ``target``; the last one may overshoot."""
    total = entries.agg(F.coalesce(F.sum("logical_bytes"), F.lit(0))).first()[0]
    rows = ordered.running_sum_by_digest(entries, "cid", F.col("logical_bytes"), "before")
    return rows.filter(F.lit(total) - F.col("before") > target).drop("before")


def evict_for_reserve(entries: DataFrame, available: int, reserve: int) -> DataFrame:
    """Evict what the reserve lacks."""
    total = entries.agg(F.coalesce(F.sum("logical_bytes"), F.lit(0))).first()[0]
    return evict_to(entries, max(0, total - max(0, reserve - available)))


def shortfall(available: Column, projected: Column, reserve: Column) -> Column:
    """What is missing of the reserve after the allocation; 0 if it holds. Subtraction saturates at 0."""
    return F.greatest(reserve - F.greatest(available - projected, F.lit(0)), F.lit(0))


def admission(host: Column, guest: Column, projected: Column, host_reserve: Column, guest_reserve: Column) -> Column:
    """struct(outcome, host_shortfall, guest_shortfall, required_reclaim)."""
    h, g = shortfall(host, projected, host_reserve), shortfall(guest, projected, guest_reserve)
    outcome = F.when((h > 0) & (g > 0), "host_and_guest").when(h > 0, "host").when(g > 0, "guest").otherwise("admitted")
    return F.struct(outcome.alias("outcome"), h.alias("host_shortfall"), g.alias("guest_shortfall"), F.greatest(h, g).alias("required_reclaim"))


def admit(entries: DataFrame, host: int, guest: int, projected: int, host_reserve: int, guest_reserve: int) -> tuple[bool, DataFrame | None]:
    """Whether the allocation is admitted, and what to evict first if it isn't yet."""
    lack = max(0, host_reserve - max(host - projected, 0), guest_reserve - max(guest - projected, 0))
    return (True, None) if not lack else (False, evict_for_reserve(entries, 0, lack))
