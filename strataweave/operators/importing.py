"""Deduplicating import: contents are stored once, names always."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, key: str, order: list) -> DataFrame:
    """Adds ``is_first``: whether the row is the first of its key."""
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1)


def first_rows(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The first row of each key, by a map-side minimum instead of a sort."""
    return df.groupBy(key).agg(F.min(F.struct(order, *columns)).alias("__f")).select(key, "__f.*")


def new_contents(incoming: DataFrame, known: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Rows to store: one per content that is not known yet."""
    return first_rows(incoming.join(known.select(key), key, "left_anti"), key, order, *columns)


def import_summary(df: DataFrame, by: str, key: str, size: str, order: str) -> DataFrame:
    """Per ``by``: seen, written (first holder of a content in the whole import), deduplicated, raw bytes."""
    holders = df.groupBy(key).agg(F.min_by(by, order).alias(by))
    written_ = holders.groupBy(by).agg(F.count("*").alias("objects_written"))
    seen = df.groupBy(by).agg(F.count("*").alias("objects_seen"), F.sum(size).alias("raw_bytes"))
    out = seen.join(written_, by, "left").fillna(0, ["objects_written"])
    return out.withColumn("objects_deduplicated", F.col("objects_seen") - F.col("objects_written"))


def conflicts(df: DataFrame, name: list[str], key: str) -> DataFrame:
    """Names that stand for several contents."""
    return df.groupBy(*name).agg(F.countDistinct(key).alias("contents")).filter("contents > 1")


def missing(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Names whose content is not known."""
    return names.join(known.select(key), key, "left_anti")


def rotate(df: DataFrame, by: str, order: str, length: str, target: int, header: int = 64, footer: int = 64) -> DataFrame:
    """Adds ``chunk`` and ``chunk_offset``: records go to the open chunk of their ``by`` while it stays within ``target``.

    The open length depends on all earlier rotations, so each ``by`` is read in
    order by one task, as a stream of batches: memory is one batch, and time is
    that of the largest ``by``, as for the single writer this stands for.
    """

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        now, chunk, end = object(), 0, header
        for batch in batches:
            keys, sizes = batch.column(by).to_pylist(), batch.column(length).to_pylist()
            chunks, offsets = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            for i, (k, n) in enumerate(zip(keys, sizes)):
                if k != now:
                    now, chunk, end = k, 0, header
                elif end + n + footer > target and end > header:
                    chunk, end = chunk + 1, header
                chunks[i], offsets[i] = chunk, end
                end += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks), pa.array(offsets)], [*batch.schema.names, "chunk", "chunk_offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(walk, f"{fields}, chunk long, chunk_offset long")
