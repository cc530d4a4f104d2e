"""Streaming forms: event counters and job states over an event stream."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.operators.jobs import STEPS
from strataweave.session import shared_dir

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def metrics(events: DataFrame, outcome) -> DataFrame:
    """Counts by type and outcome; the same plan serves tables and streams."""
    return events.withColumn("outcome", outcome).groupBy("event_type", "outcome").agg(F.count("*").alias("events"))


def drained(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over what is there now and return its last result, from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/strataweave/{label}-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


def event_stream(spark: SparkSession, path: str, schema: T.StructType = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def job_states(events: DataFrame, key: str, operation: str) -> DataFrame:
    """Update stream of (key, state, attempts, rejected); the state of a key is kept between batches.

    Events must come ordered by key, as from one log; each batch is applied in
    its order of ``event_id``.
    """
    legal = {(o, a): b for o, a, b in STEPS}
    kind = events.schema[key].dataType.simpleString()

    def apply(ident, batches: Iterator, state) -> Iterator:
        import pandas as pd

        now, attempts, rejected = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("event_id")
        for op in rows[operation]:
            to = legal.get((op, now))
            if to is None:
                rejected += 1
            else:
                now, attempts = to, attempts + (to == 2)
        state.update((now, attempts, rejected))
        yield pd.DataFrame({key: [ident[0]], "state": [now], "attempts": [attempts], "rejected": [rejected]})

    out = f"`{key}` {kind}, state int, attempts long, rejected long"
    return events.select(key, "event_id", operation).groupBy(key).applyInPandasWithState(apply, out, "state int, attempts long, rejected long", "update", "NoTimeout")
