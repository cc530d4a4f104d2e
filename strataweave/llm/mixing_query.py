"""Query op9_mix_sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import mixing
from strataweave.session import read_table


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    slim = mixing.slim_of(mixing.measured(docs))
    out = mixing.mixed(slim, slim)
    return out.selectExpr("doc_id", "__mix_size as size", "__mix_source as source_size", "__mix_target as target", "__mix_copies * __mix_size as taken")


SQL = r"""
with m as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    (('0x' || md5('mix' || chr(31) || coalesce(doc_id::varchar, '') || chr(31) || coalesce(text, ''))[1:13])::bigint + 0.5::double) / 4503599627370496.0::double as u
  from documents),
r as (select *, length(bin(size))::bigint as c from m),
strata as (select source as s, c, sum(size)::bigint as size from r group by all),
src as (select s, sum(size)::bigint as source_size, row_number() over (order by s nulls last) as n from strata group by s),
src2 as (select *, [5, 2, 1][((n - 1) % 3 + 1)::int] as w, source_size * 2 as cap from src),
src3 as (select *, 1.5::double * sum(source_size) over () as total, sum(cap) over () as most, sum(w) over () as allw,
  coalesce(sum(cap) over (order by cap::double / w, n rows between unbounded preceding and 1 preceding), 0) as caps,
  coalesce(sum(w) over (order by cap::double / w, n rows between unbounded preceding and 1 preceding), 0) as ws from src2),
src4 as (select *, max((total - caps)::double / (allw - ws)::double) over () as lvl from src3),
src5 as (select s, source_size, case when total >= most then cap::double else least(cap::double, lvl * w) end as target from src4),
cl as (select strata.*, source_size, target, size * c as w, size * 2 as cap from strata join src5 on strata.s is not distinct from src5.s where size > 0),
cl3 as (select *, target as total, sum(cap) over (partition by s) as most, sum(w) over (partition by s) as allw,
  coalesce(sum(cap) over (partition by s order by cap::double / w, c rows between unbounded preceding and 1 preceding), 0) as caps,
  coalesce(sum(w) over (partition by s order by cap::double / w, c rows between unbounded preceding and 1 preceding), 0) as ws from cl),
cl4 as (select *, max((total - caps::double) / (allw - ws)::double) over (partition by s) as lvl from cl3),
cl5 as (select s, c, size, target, least(2.0::double, (case when total >= most then cap::double else least(cap::double, lvl * w) end) / size) as e from cl4),
cl6 as (select *, floor(e)::bigint as whole, target - (sum(floor(e)::bigint * size) over (partition by s))::double as rest from cl5),
q as (select r.*, e, whole, rest, u / (1.0::double - u) * ((1.0::double - (e - whole)) / nullif(e - whole, 0)) as odds from r left join cl6 on r.source is not distinct from cl6.s and r.c = cl6.c),
k as (select *, case when e - whole > 0 and size > 0 then floor(odds / (odds + 1.0::double) * 281474976710656.0::double)::bigint end as rnk from q),
t as (select *, coalesce(sum(size) over (partition by source order by rnk, size, doc_id rows between unbounded preceding and 1 preceding), 0) as before from k where rnk is not null),
taken as (select doc_id, source, size, whole + (before + size / 2.0::double <= rest)::bigint as copies from t
  union all select doc_id, source, size, coalesce(whole, 0) from k where rnk is null)
select doc_id, size, source_size, target, (copies * size)::bigint as taken
from taken join src5 on taken.source is not distinct from src5.s
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": SQL}
