"""The corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets all that its predecessor kept.
Stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import jaccard, mil, mixing, packing, pii
from strataweave.llm.packing_query import tokenizer_path
from strataweave.llm.pii_query import secret
from strataweave.session import read_table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return mil.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, null ids last; documents without words all stay.

    A document is its id and its text, so an id may name several texts and null
    ids are told apart; of rows equal in both one stays.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    # the least key of a component is the document that stays
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), digest.alias("digest")).alias("__key"), "text")
    groups = jaccard.near_duplicates(keyed, key="__key")
    kept = groups.filter("n_shingles = 0 or doc_id <=> component_id").select(F.col("doc_id.id").alias("__kept"), F.col("doc_id.digest").alias("__of"), F.col("n_shingles").alias("__n")).distinct()
    out = docs.withColumn("__digest", digest)
    out = out.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.col("__digest") == F.col("__of")))
    empty = out.filter("__n = 0").select(*docs.columns)
    # what is left of a key are copies of one row
    return out.filter("__n > 0").dropDuplicates(["doc_id", "__digest"]).select(*docs.columns).unionByName(empty)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars counts the new text."""
    out = pii.with_surrogates(docs, secret(spark))
    return out.withColumn("n_chars", F.when(F.col("__pii_n") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their sequences."""
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII surrogates", surrogates),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Model scores, surrogates and token ids are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage-{n}")
    return docs
