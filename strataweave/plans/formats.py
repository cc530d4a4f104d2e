"""Queries over encoded chunk files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.operators import importing
from strataweave.plans.content import DOCS, RECORD
from strataweave.plans.registry import query
from strataweave.session import read_table
from strataweave.sources import chunks

TARGET = 32768


def chunk_files(spark, sf_dir, codec: str = "raw"):
    """The documents packed into sealed chunk files, rotated per source."""
    payload = F.coalesce("text", F.lit("")).cast("binary")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", payload.alias("payload"))
    docs = docs.withColumn("record_length", identity.record_length(F.octet_length("payload")))
    return chunks.build(importing.rotate(docs, "source", "doc_id", "record_length", TARGET), "source", "chunk", "doc_id", "payload", codec=codec)


@query("record_roundtrip", f"""
with recursive d as (select source, doc_id, cid, size, sha256('blob') as x, {RECORD} as n, row_number() over (partition by source order by doc_id) as i from {DOCS}),
r as (select source, doc_id, cid, size, n, i, 0::bigint as chunk, 64::bigint as at_byte from d where i = 1
  union all select d.source, d.doc_id, d.cid, d.size, d.n, d.i, case when r.at_byte + r.n + d.n + 64 > {TARGET} then r.chunk + 1 else r.chunk end,
    case when r.at_byte + r.n + d.n + 64 > {TARGET} then 64 else r.at_byte + r.n end from r join d on d.source = r.source and d.i = r.i + 1)
select source || '/' || printf('%020d', chunk) || '.sealed' as path, at_byte as record_offset, n as record_length, size as raw_length, cid, cid as payload_cid from r""")
def record_roundtrip(spark, sf_dir):
    """Encode, seal, scan strictly, decode: every record comes back where it was put."""
    out = chunks.scan(chunk_files(spark, sf_dir))
    return out.select("path", F.col("offset").alias("record_offset"), "record_length", "raw_length", F.lower(F.hex("content_id")).alias("cid"), identity.content_id(F.col("payload")).alias("payload_cid"))


REPORT = f"""
with recursive d as (select source, doc_id, size, {RECORD} as n, row_number() over (partition by source order by doc_id) as i from {DOCS}),
r as (select source, doc_id, size, n, i, 0::bigint as chunk, 64::bigint as at_byte from d where i = 1
  union all select d.source, d.doc_id, d.size, d.n, d.i, case when r.at_byte + r.n + d.n + 64 > {TARGET} then r.chunk + 1 else r.chunk end,
    case when r.at_byte + r.n + d.n + 64 > {TARGET} then 64 else r.at_byte + r.n end from r join d on d.source = r.source and d.i = r.i + 1),
f as (select source, chunk, count(*) as records, 64 + sum(n)::bigint as ends, arg_min(size, at_byte) as first_size, max(at_byte) as last_at, (chunk + length(source)) % 4 as damage from r group by all)
select source || '/' || printf('%020d', chunk) || case when damage = 0 then '.sealed' else '.open' end as path,
  case damage when 1 then records - 1 when 2 then 0 else records end::bigint as records, case damage when 1 then last_at when 2 then 64 else ends end::bigint as retained_bytes,
  case damage when 1 then ends + 64 - 100 - last_at when 2 then ends else 0 end::bigint as cut_bytes,
  case damage when 0 then null when 2 then case when first_size >= 6 then 'payload checksum' else 'record length' end else 'truncated' end as error,
  case damage when 0 then 'none' when 3 then 'publish_seal' else 'truncate' end as action from f"""


@query("chunk_corruption_report", REPORT)
def chunk_corruption_report(spark, sf_dir):
    """Reports of files of which some are cut off, some have a flipped byte, some lost their seal."""
    files = chunk_files(spark, sf_dir)
    chunk, source = F.regexp_extract("path", r"/([0-9]+)\.sealed$", 1).cast("long"), F.substring_index("path", "/", 1)
    n = F.pmod(chunk + F.length(source), F.lit(4))
    size = F.octet_length("content")
    flipped = F.concat(F.substring("content", 1, 200), F.unhex(F.lit("FF")), F.substring(F.col("content"), F.lit(202), size))
    damaged = F.when(n == 1, F.substring(F.col("content"), F.lit(1), size - 100)).when(n == 2, flipped).otherwise(F.col("content"))
    name = F.when(n == 0, F.col("path")).otherwise(F.replace("path", F.lit(".sealed"), F.lit(".open")))
    return chunks.reports(files.select(name.alias("path"), damaged.alias("content")))
