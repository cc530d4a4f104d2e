"""Query op2_quality_mil."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import mil
from strataweave.session import read_table


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.train(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", mil.held_out(F.col("doc_id")).alias("held_out"), mil.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= mil.THRESHOLD).cast("int"))


QUERIES = {"op2_quality_mil": op2_quality_mil}
ORACLES = {}
