"""Durable stores of jobs (a catalog table), a scrub schedule and a migration (a record file each).

Handlers are functions; an error in one is a durable failure, never the end of the
worker.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.operators.jobs import STATES, STEPS
from strataweave.sources import manifests
from strataweave.sources.catalog import TABLES, Catalog
from strataweave.sources.files import Files

QUEUED, RUNNING, SUCCEEDED, FAILED = STATES


class StateError(ValueError):
    """A step that the state does not allow."""


class JobStore:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog, self.spark = catalog, catalog.spark

    def list(self) -> DataFrame:
        """All jobs by id."""
        return self.catalog.read("jobs").orderBy("job_id")

    def get(self, job_id: bytes) -> dict | None:
        row = self.catalog.read("jobs").filter(F.col("job_id") == F.lit(bytearray(job_id))).first()
        return None if row is None else {k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.asDict().items()}

    def _put(self, job: dict) -> dict:
        manifests.JOB.encode({"id": job["job_id"], **{k: job[k] for k in ("state", "attempts", "kind", "payload", "last_error")}})  # its rules
        names = [c.split()[0] for c in TABLES["jobs"][0].split(", ")]
        self.catalog.apply(put={"jobs": self.spark.createDataFrame([tuple(job[n] for n in names)], TABLES["jobs"][0])})
        return job

    def enqueue(self, kind: bytes, payload: bytes, job_id: bytes | None = None) -> bytes:
        """A new queued job; an id that is there already is refused."""
        job_id = job_id or uuid.uuid4().bytes
        if self.get(job_id) is not None:
            raise StateError("the id is taken")
        return self._put({"job_id": job_id, "kind": kind, "payload": payload, "state": QUEUED, "attempts": 0, "last_error": None})["job_id"]

    def _step(self, job_id: bytes, operation: str, **change) -> dict:
        job = self.get(job_id)
        if job is None:
            raise StateError("no such job")
        to = next((b for name, a, b in STEPS if name == operation and a == job["state"]), None)
        if to is None:
            raise StateError(f"{operation} from {STATES[job['state']]}")
        return self._put(job | change | {"state": to, "attempts": job["attempts"] + (to == RUNNING)})

    def start(self, job_id: bytes) -> dict:
        return self._step(job_id, "start")

    def succeed(self, job_id: bytes) -> dict:
        return self._step(job_id, "succeed", last_error=None)

    def fail(self, job_id: bytes, error: bytes) -> dict:
        return self._step(job_id, "fail", last_error=error)

    def retry(self, job_id: bytes) -> dict:
        return self._step(job_id, "retry")

    def claim_next(self, kinds: list[bytes] | None = None) -> dict | None:
        """The queued job with the smallest id, of the kinds this worker takes; it runs now, with one attempt more."""
        queued = self.catalog.read("jobs").filter(F.col("state") == QUEUED)
        if kinds is not None:
            queued = queued.filter(F.col("kind").isin([bytearray(k) for k in kinds]) if kinds else F.lit(False))
        first = queued.agg(F.min("job_id").alias("job_id")).first().job_id
        return None if first is None else self.start(bytes(first))

    def execute_next(self, handler: Callable[[dict], None], kinds: list[bytes] | None = None) -> str:
        """``idle``, ``succeeded`` or ``failed``."""
        job = self.claim_next(kinds)
        if job is None:
            return "idle"
        try:
            handler(job)
        except Exception as why:  # noqa: BLE001  whatever a handler raises is the job's failure
            self.fail(job["job_id"], (str(why) or type(why).__name__).encode())
            return "failed"
        self.succeed(job["job_id"])
        return "succeeded"

    def recover(self) -> int:
        """At startup, jobs that ran are queued again, attempts kept; how many."""
        running = self.catalog.read("jobs").filter(F.col("state") == RUNNING).withColumn("state", F.lit(QUEUED))
        n = running.count()
        if n:
            self.catalog.apply(put={"jobs": running})
        return n

    def records(self) -> DataFrame:
        """job_id and record: the jobs as their encoded records, for a mirror."""
        value = F.struct("state", F.col("job_id").alias("id"), "attempts", "kind", "payload", "last_error")
        return self.catalog.read("jobs").select("job_id", manifests.encoded(value, manifests.JOB).alias("record"))

    def mirror(self, records: DataFrame) -> int:
        """Take over encoded records (record binary); how many. One that can't be decoded is an error."""
        found = records.select(manifests.decoded(F.col("record"), manifests.JOB).alias("d"))
        if (bad := found.filter("d.error is not null").first()) is not None:
            raise manifests.FormatError(bad.d.error)
        rows = found.select(F.col("d.value.id").alias("job_id"), "d.value.kind", "d.value.payload", "d.value.state", "d.value.attempts", "d.value.last_error")
        self.catalog.apply(put={"jobs": rows})
        return rows.count()


class ScrubStore:
    """One schedule in one file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.files = path, Files(spark)

    def read(self) -> dict | None:
        data = self.files.read(self.path)
        return None if data is None else manifests.SCRUB.decode(data)

    def _write(self, state: dict) -> dict:
        self.files.write(self.path, manifests.SCRUB.encode(state))
        return state

    def configure(self, interval: int, now: int) -> dict:
        """Set the interval; a schedule that runs can't be changed."""
        state = self.read() or {"run_state": manifests.IDLE, "last_started": None, "last_completed": None, "consecutive_failures": 0, "recovered_interrupted_runs": 0}
        if state["run_state"] == manifests.RUNNING:
            raise StateError("a scrub runs")
        return self._write(state | {"interval": interval, "next_due": now + interval})

    def due(self, now: int) -> bool:
        state = self.read()
        return state is not None and state["run_state"] == manifests.IDLE and state["next_due"] <= now

    def begin_if_due(self, now: int) -> dict | None:
        return self._write(self.read() | {"run_state": manifests.RUNNING, "last_started": now}) if self.due(now) else None

    def finish(self, now: int, succeeded: bool) -> dict:
        state = self.read()
        if state is None or state["run_state"] != manifests.RUNNING:
            raise StateError("no scrub runs")
        done = {"last_completed": now, "consecutive_failures": 0} if succeeded else {"consecutive_failures": min(state["consecutive_failures"] + 1, manifests.MAX_FAILURES)}
        return self._write(state | done | {"run_state": manifests.IDLE, "next_due": now + state["interval"]})

    def recover(self, now: int) -> int:
        """At startup an interrupted run is due at once; how many there were."""
        state = self.read()
        if state is None or state["run_state"] != manifests.RUNNING:
            return 0
        self._write(state | {"run_state": manifests.IDLE, "next_due": now, "recovered_interrupted_runs": state["recovered_interrupted_runs"] + 1})
        return 1

    def execute_if_due(self, now: int, handler: Callable[[dict], None]) -> str:
        """``not_due``, ``succeeded`` or ``failed``."""
        state = self.begin_if_due(now)
        if state is None:
            return "not_due"
        try:
            handler(state)
            good = True
        except Exception:  # noqa: BLE001
            good = False
        self.finish(now, good)
        return "succeeded" if good else "failed"


class MigrationStore:
    """One migration in one file; ``version`` is what the store has without any."""

    NEXT = {manifests.COPYING: manifests.VALIDATING, manifests.VALIDATING: manifests.PUBLISHED}

    def __init__(self, spark: SparkSession, path: str, version: int = 1) -> None:
        self.path, self.files, self.version = path, Files(spark), version

    def read(self) -> dict | None:
        data = self.files.read(self.path)
        return None if data is None else manifests.MIGRATION.decode(data)

    def status(self) -> dict:
        """The active version is the target's only once it is published."""
        found = self.read()
        if found is None:
            return {"state": 0, "active_version": self.version}
        return {"state": found["state"], "active_version": found["to_version"] if found["state"] == manifests.PUBLISHED else found["from_version"]}

    def begin(self, to_version: int, migration_id: bytes | None = None) -> dict:
        """Only one at a time, and only to a newer version."""
        now = self.status()
        if now["state"] not in (0, manifests.PUBLISHED):
            raise StateError("a migration is under way")
        record = {"id": migration_id or uuid.uuid4().bytes, "from_version": now["active_version"], "to_version": to_version, "state": manifests.COPYING, "transition_count": 1}
        self.files.write(self.path, manifests.MIGRATION.encode(record))
        return record

    def transition(self, expected: int, target: int) -> dict:
        found = self.read()
        if found is None or found["state"] != expected or self.NEXT.get(expected) != target:
            raise StateError(f"no step from {expected} to {target} now")
        found |= {"state": target, "transition_count": found["transition_count"] + 1}
        self.files.write(self.path, manifests.MIGRATION.encode(found))
        return found

    def execute_once(self, handlers: dict[int, Callable[[dict], None]]) -> str:
        """The phase that is next: ``idle``, ``advanced``, ``published`` or ``failed``; a failed phase can be run again."""
        found = self.read()
        if found is None or found["state"] == manifests.PUBLISHED:
            return "idle"
        try:
            handlers[found["state"]](found)
        except Exception:  # noqa: BLE001
            return "failed"
        after = self.transition(found["state"], self.NEXT[found["state"]])
        return "published" if after["state"] == manifests.PUBLISHED else "advanced"
