"""Query op4_exact_top_k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import topk
from strataweave.session import read_table


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 vectors of highest integer inner product with each query."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, 5, is_query=F.col("vec_id") % 50 == 0)


SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r, q.vec_id as query_id, c.vec_id, list_dot_product(q.x::double[], c.x::double[])::bigint as score from v q join v c on q.r <> c.r where q.vec_id % 50 = 0),
k as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from k where rank <= 5
"""

QUERIES = {"op4_exact_top_k": op4_exact_top_k}
ORACLES = {"op4_exact_top_k": SQL}
