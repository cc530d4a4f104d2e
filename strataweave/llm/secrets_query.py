"""Query op3_secret_scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm import secrets
from strataweave.session import read_table


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets in every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan_secrets(docs)
    kinds = [k for k, *_ in secrets.KINDS]
    base = F.filter("found", lambda x: x["__n"] < len(kinds))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    held = F.transform(F.filter("found", lambda x: x["__n"] >= len(kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["owners"].cast("string"), x["repositories"].cast("string")))
    return found.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in kinds], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("found").alias("spans"),
        *[of(k).alias(f"n_{k}") for k in secrets.ADDED],
        F.array_join(held, ",").alias("ownership"),
    )


def _sql() -> str:
    """The same by window functions over the pieces between the matches."""
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for n, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        value = f"regexp_extract(found, '{quoted(pattern)}', {group})"
        parts.append(f"""
  select rid, owner, repo, {n} as n, '{kind}' as kind, e - length(found) as s, e, {value} as value from (
    select rid, owner, repo, found, sum(length(gap) + coalesce(length(found), 0)) over (partition by rid order by i)::bigint as e from (
      select rid, owner, repo, unnest(string_split_regex(text, '{quoted(pattern)}')) as gap,
        unnest(list_concat(regexp_extract_all(text, '{quoted(pattern)}', 0), [null])) as found,
        unnest(range(1, len(string_split_regex(text, '{quoted(pattern)}')) + 1)) as i from d))
  where found is not null and length({value}) >= {least}""")
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, source as owner,
    concat_ws('/', source, lang) as repo from documents),
base as ({' union all '.join(parts)}),
held as (select sha256(value) as digest, count(distinct coalesce(owner, chr(1))) as owners, count(distinct repo) as repos from base group by 1),
judged as (select *, owners >= {secrets.MIN_OWNERS} or owners >= 2 and repos >= {secrets.MIN_REPOSITORIES} as copied from held),
added as (select distinct rid, case when copied then 4 else 3 end as n,
    case when copied then 'example' else 'live' end as kind, e - length(value) as s, e, value, owners, repos
  from base join judged on sha256(value) = digest
  where copied or (len(list_distinct(string_split(value, ''))) >= {secrets.MIN_DISTINCT} and regexp_matches(value, '[0-9]')
    and regexp_matches(value, '[A-Za-z]') and not regexp_matches(lower(value), 'example|placeholder|changeme|xxxx'))),
every as (select rid, n, kind, s, e, null as owners, null as repos from base union all select rid, n, kind, s, e, owners, repos from added),
per as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  count(*) filter (kind = 'live') as n_live, count(*) filter (kind = 'example') as n_example,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, n, e) filter (n < 3) as base_said, string_agg(kind || ':' || s || ':' || e, ',' order by s, n, e) as said,
  string_agg(kind || ':' || s || ':' || owners || ':' || repos, ',' order by s, n, e) filter (n >= 3) as held_by
  from every group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base_said, '')) as base_sha256, coalesce(said, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example, coalesce(held_by, '') as ownership
from d left join per using (rid)
"""


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLES = {"op3_secret_scan": _sql()}
