"""Keyed state machines in batch: jobs, scrub schedules, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.operators import ordered

# States by number (0: no job yet), and legal steps (operation, from, to).
STATES = {1: "queued", 2: "running", 3: "succeeded", 4: "failed"}
STEPS = (("enqueue", 0, 1), ("start", 1, 2), ("succeed", 2, 3), ("fail", 2, 4), ("retry", 4, 1))
MIN_INTERVAL, MAX_INTERVAL = 60, 366 * 86_400
MIGRATION_STEPS = {"copying": "validating", "validating": "published"}
#: Events that one fold takes at once.
PART = 1000


def step(state: Column, operation: Column) -> Column:
    """The next state, or -1 if the step is not legal."""
    out = F.lit(-1)
    for name, a, b in STEPS:
        out = F.when((operation == name) & (state == a), b).otherwise(out)
    return out


def _fold(events: Column, start: Column) -> Column:
    """struct(state, attempts, rejected) after a list of operations."""
    zero = F.struct(start.cast("int").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("rejected"))

    def one(acc: Column, e: Column) -> Column:
        to = step(acc["state"], e)
        return F.struct(
            F.when(to < 0, acc["state"]).otherwise(to).cast("int").alias("state"), (acc["attempts"] + F.when(to == 2, 1).otherwise(0)).alias("attempts"),
            (acc["rejected"] + F.when(to < 0, 1).otherwise(0)).alias("rejected"),
        )

    return F.aggregate(events, zero, one)


def replay(events: DataFrame, key: str, order: list[str], operation: str) -> DataFrame:
    """key, state, attempts, rejected after all operations of each key, in order.

    Steps compose, so a key's events are folded in parts, each from every
    possible state, and the parts are chained: a key with a third of all events
    is no task's load.
    """
    placed = ordered.row_number(events.select(key, *[c for c in order if c != key], operation), order, "__n", by=[key])
    part = placed.withColumn("__part", F.floor((F.col("__n") - 1) / PART))
    lists = part.groupBy(key, "__part").agg(F.sort_array(F.collect_list(F.struct("__n", F.col(operation).alias("op")))).alias("x"))
    tables = lists.select(key, "__part", F.transform(F.array(*[F.lit(s) for s in range(5)]), lambda s: _fold(F.col("x.op"), s)).alias("t"))
    chained = tables.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__part", "t"))).alias("x"))
    zero = F.struct(F.lit(0).cast("int").alias("state"), F.lit(0).cast("long").alias("attempts"), F.lit(0).cast("long").alias("rejected"))

    def chain(acc: Column, p: Column) -> Column:
        got = F.get(p["t"], acc["state"])
        return F.struct(got["state"].alias("state"), (acc["attempts"] + got["attempts"]).alias("attempts"), (acc["rejected"] + got["rejected"]).alias("rejected"))

    return chained.select(key, F.aggregate("x", zero, chain).alias("f")).select(key, "f.state", "f.attempts", "f.rejected")


def claim_first(jobs: DataFrame, by: str, order: str) -> DataFrame:
    """The queued job with the smallest id of each worker's kind."""
    return jobs.groupBy(by).agg(F.min(order).alias(order))


def state_counts(jobs: DataFrame, state: str = "state") -> DataFrame:
    """One row of four counts, zeros included."""
    return jobs.agg(*[F.count_if(F.col(state) == n).alias(name) for n, name in STATES.items()])


def job_is_valid(state: Column, attempts: Column, error: Column) -> Column:
    """Invariants of a record: failed has an error, succeeded has none, all that ran have attempts."""
    return (
        F.when(state == 4, error.isNotNull() & (F.length(error) > 0) & (attempts > 0)).when(state == 3, error.isNull() & (attempts > 0))
        .when(state == 2, attempts > 0).when(state == 1, F.lit(True)).otherwise(F.lit(False))
    )


def recovered(jobs: DataFrame) -> DataFrame:
    """Startup: running jobs are queued again; attempts stay."""
    return jobs.withColumn("state", F.when(F.col("state") == 2, 1).otherwise(F.col("state")))


def scrub_due(interval: Column, last: Column, now: Column, idle: Column) -> Column:
    """Whether an idle schedule of a legal interval is due."""
    return idle & interval.between(MIN_INTERVAL, MAX_INTERVAL) & (last + interval <= now)


def scrub_finished(now: Column, interval: Column, failures: Column, succeeded: Column) -> Column:
    """struct(next_due, consecutive_failures) after a run."""
    return F.struct((now + interval).alias("next_due"), F.when(succeeded, 0).otherwise(failures + 1).alias("consecutive_failures"))


def migration_step(state: Column) -> Column:
    """The only next state of a migration, or null."""
    out = F.lit(None).cast("string")
    for a, b in MIGRATION_STEPS.items():
        out = F.when(state == a, b).otherwise(out)
    return out


def active_version(state: Column, from_version: Column, to_version: Column) -> Column:
    return F.when(state == "published", to_version).otherwise(from_version)
