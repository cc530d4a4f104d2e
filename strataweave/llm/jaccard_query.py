"""Query op8_ngram_jaccard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import jaccard
from strataweave.session import read_table


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
with recursive
w as (select doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) end as gs from w),
g as (select doc_id, unnest(gs) as gram from s),
shared as (select doc_id, gram from g where gram in (select gram from g group by gram having count(distinct doc_id) > 1)),
n as (select doc_id, len(gs) as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from shared a join shared b using (gram) where a.doc_id <> b.doc_id group by all),
e as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * i >= 75 * (x.n + y.n - i)),
r as (select doc_id as root, doc_id as reached from n union select r.root, e.b from r join e on r.reached = e.a)
select n.doc_id, n.n::bigint as n_shingles, m.component_id from n join (select root, min(reached) as component_id from r group by root) m on m.root = n.doc_id
"""

QUERIES = {"op8_ngram_jaccard": op8_ngram_jaccard}
ORACLES = {"op8_ngram_jaccard": SQL}
