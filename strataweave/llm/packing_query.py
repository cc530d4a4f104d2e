"""Query op6_best_fit_packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import packing
from strataweave.session import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLES = {}
