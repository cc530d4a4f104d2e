"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the records uniformly into buckets of bounded size by a
seeded hash of what they hold.  Pass two takes one bucket at a time, orders it
by that hash, shuffles it by Fisher-Yates with a generator seeded by the bucket,
and writes it in that order.  Buckets one after another are then a uniform random
permutation of the table; position ``p`` of it goes to shard ``p mod n``, slot
``p div n``, so the counts of the shards differ by one at most and slots have no
gaps (law ``rows``).  The seed and the rows decide all of it: however the input
is split, a row gets the same place.

Rows that are equal in every column can't be told apart, so it doesn't matter
which of them gets which place.  A row that occurs more than ``COPIES`` times is
taken out, and made again as often as it was counted, each copy with a hash of
its own, so copies spread over all buckets like other rows.

The written table fixes every random choice: a retried task rewrites its own
bucket, and positions are counted from what was committed.  Memory: one bucket
of ``bucket_bytes`` in a Python worker.  Bucket counts, one row per bucket, are
summed by a window over that summary only.

Defined cases: null texts are records of size 1; repeated rows are separate
records; null ids are kept; an empty table gives no row; other columns are
carried whatever their names are (working columns start with ``__shard_``); a
column must be of a type that Spark hashes (any but maps).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataweave.session import written

LAW = "rows"
BUCKET_BYTES = 24 << 20
#: Equal rows that may share a bucket, and copies that one row makes in a task.
COPIES = 1000


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(1).cast("long")


def fisher_yates(n: int, seed: int):
    """A uniform permutation of range(n): Durstenfeld's form, draws from a seeded PCG64."""
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(seed))
    order = np.arange(n)
    picks = draw.integers(0, np.arange(n, 0, -1)) if n else []
    items = order.tolist()
    for i, k in zip(range(n - 1, -1, -1), picks):
        items[i], items[k] = items[k], items[i]
    return items


def shuffled(docs: DataFrame, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """The written permutation: the columns of ``docs``, __shard_size, __shard_bucket, __shard_at."""
    spark = docs.sparkSession
    names = sorted(docs.columns)
    hashes = {f"__shard_h{k}": F.xxhash64(F.lit(seed + k), *[F.col(f"`{c}`") for c in names], F.array(*[F.col(f"`{c}`").isNull() for c in names])) for k in (0, 1)}
    rows = docs.withColumns({"__shard_size": record_size(F.col(text)), **hashes})
    held = written(rows.groupBy(*hashes).agg(F.count("*").alias("__shard_n"), F.max("__shard_size").alias("__shard_size")), "shard-keys")
    told = held.agg(F.sum(F.col("__shard_n") * F.col("__shard_size")), F.max("__shard_n")).first()
    buckets = max(1, math.ceil((told[0] or 0) / bucket_bytes))
    rows = rows.withColumn("__shard_copy", F.lit(0).cast("long"))
    if (told[1] or 0) > copies:
        many = held.filter(F.col("__shard_n") > copies).select(*hashes, "__shard_n")
        one = rows.join(many, list(hashes)).dropDuplicates(list(hashes))
        turns = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__shard_n") - 1) / copies)))
        one = one.withColumn("__shard_turn", turns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("__shard_turn", *hashes))
        upto = F.least(F.col("__shard_n"), (F.col("__shard_turn") + 1) * copies) - 1
        one = one.withColumn("__shard_copy", F.explode(F.sequence(F.col("__shard_turn") * copies, upto)))
        rows = rows.join(many.drop("__shard_n"), list(hashes), "left_anti").select(*rows.columns).unionByName(one.select(*rows.columns))
    place = F.xxhash64(F.lit(seed), *hashes, "__shard_copy")
    scattered = rows.withColumn("__shard_bucket", F.pmod(place, F.lit(buckets))).drop("__shard_copy")
    # the exchange is pass one; the sort below lets a task take its buckets one by one
    scattered = scattered.repartition(max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "__shard_bucket")
    scattered = scattered.sortWithinPartitions("__shard_bucket", *hashes).drop(*hashes)
    schema = T.StructType([*scattered.schema.fields, T.StructField("__shard_at", T.LongType())])

    def second_pass(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def dealt(parts: list, bucket: int):
            table = pa.Table.from_batches(parts)
            parts.clear()
            n, done = table.num_rows, 0
            order = pa.array(fisher_yates(n, seed * 1_000_003 + bucket), pa.int64())
            step = max(1, n * (4 << 20) // max(1, table.nbytes))
            while done < n:
                out = table.take(order.slice(done, step))
                out = out.append_column("__shard_at", pa.array(range(done, done + out.num_rows), pa.int64()))
                done += out.num_rows
                yield from out.combine_chunks().to_batches()

        held, bucket = [], None
        for batch in batches:
            ids = batch.column("__shard_bucket")
            for b in pc.unique(ids).to_pylist():
                if b != bucket and held:
                    yield from dealt(held, bucket)
                bucket = b
                held.append(batch.filter(pc.equal(ids, b)))
        if held:
            yield from dealt(held, bucket)

    out = scattered.mapInArrow(second_pass, schema)
    return written(out, "shards")


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", seed: int = 17, bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """The columns of ``docs`` with __shard_size, __shard (0 to shards - 1) and __shard_slot."""
    rows = shuffled(docs, text, seed, bucket_bytes, copies)
    counts = rows.groupBy("__shard_bucket").agg(F.count("*").alias("__shard_n"))
    upto = Window.orderBy("__shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__shard_bucket"), F.coalesce(F.sum("__shard_n").over(upto), F.lit(0)).alias("__shard_start"))  # a row a bucket
    out = rows.join(starts, "__shard_bucket")
    position = F.col("__shard_start") + F.col("__shard_at")
    out = out.withColumns({"__shard": (position % shards).cast("int"), "__shard_slot": F.floor(position / shards).cast("long")})
    return out.drop("__shard_bucket", "__shard_start", "__shard_at")


def write_shards(docs: DataFrame, path: str, shards: int = 8, **options) -> DataFrame:
    """Write the shards as Parquet, one folder each, rows ordered by slot inside their files."""
    out = shard_documents(docs, shards, **options)
    out.sortWithinPartitions("__shard", "__shard_slot").write.partitionBy("__shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
