"""Query op10_shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import sharding
from strataweave.session import read_table


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the two-pass shuffle puts each document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = sharding.shard_documents(docs, shards=8)
    return out.select(
        "doc_id", F.col("__shard_size").alias("size"), "text_crc32", F.lit(sharding.LAW).alias("law"),
        F.col("__shard").alias("shard"), F.col("__shard_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op10_shards": op10_shards}
ORACLES = {}
