"""Query op5_ctw_scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import ctw
from strataweave.session import read_table

#: The longest context, in bytes: with one more byte a string fills a long.
DEPTH = 7


def op5_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unigram and the context-tree score of every whole text."""
    return ctw.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"), depth=DEPTH)


QUERIES = {"op5_ctw_scores": op5_ctw_scores}
ORACLES = {}
