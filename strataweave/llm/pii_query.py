"""Query op7_pii_surrogates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import pii
from strataweave.session import read_table


#: Key of the surrogates, as a setting of the session; the default is for the synthetic tables only.
SETTING, DEFAULT = "spark.strataweave.pii.key", "synthetic tables"


def secret(spark: SparkSession) -> bytes:
    """The key that the session names."""
    return spark.conf.get(SETTING, DEFAULT).encode()


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    out = pii.with_surrogates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
    return out.selectExpr("doc_id", "text", "__pii_n as n_entities", "__pii_spans as spans")


QUERIES = {"op7_pii_surrogates": op7_pii_surrogates}
ORACLES = {}
