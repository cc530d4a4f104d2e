"""Query op1_media_columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import media
from strataweave.session import read_table


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a container, read back, and its media columns."""
    seen = media.stored_media(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    track = F.col("m.tracks")[0]
    ranges = F.array_join(F.transform(track["keyframes"], lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("m.brand"), track["codec"], F.concat_ws("x", track["width"].cast("string"), track["height"].cast("string")),
                    F.concat_ws("/", track["duration"].cast("string"), track["timescale"].cast("string")), track["n_keyframes"].cast("string"), ranges).alias("feature"),
        track["codec"].alias("codec"), F.col("m.seconds").alias("seconds"), track["n_samples"].alias("n_samples"),
    )


QUERIES = {"op1_media_columns": op1_media_columns}
ORACLES = {}
