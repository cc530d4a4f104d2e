"""Content identity, deduplicating import and alias queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.operators import importing, maintenance, ordered
from strataweave.plans.registry import query
from strataweave.session import read_table

CID = r"sha256('{domain}\x00\x03'::blob || unhex(printf('%016X', octet_length(encode({x})))) || encode({x}))"


def cid_sql(x: str) -> str:
    return CID.format(domain=identity.DOMAIN, x=x)


DOCS = f"(select doc_id, lang, source, n_chars, {cid_sql('text')} as cid, octet_length(encode(text))::bigint as size from documents)"


def docs_with_cid(spark, sf_dir, *more: str) -> DataFrame:
    """doc_id, cid, size and the asked columns of documents."""
    payload = identity.utf8(F.col("text"))
    return read_table(spark, sf_dir, "documents").select("doc_id", *more, identity.content_id(payload).alias("cid"), F.octet_length(payload).cast("long").alias("size"))


@query("content_id_documents", f"select doc_id, cid from {DOCS}")
def content_id_documents(spark, sf_dir):
    return docs_with_cid(spark, sf_dir).select("doc_id", "cid")


@query("git_blob_oid_documents", r"select doc_id, sha1(('blob ' || octet_length(encode(text)))::blob || '\x00'::blob || encode(text)) as oid from documents")
def git_blob_oid_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", identity.native_oid(identity.utf8(F.col("text"))).alias("oid"))


@query("dedup_first_location", f"select cid, min(doc_id) as doc_id, count(*) as copies from {DOCS} group by cid")
def dedup_first_location(spark, sf_dir):
    return docs_with_cid(spark, sf_dir).groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("import_summary_by_source", f"""
with d as {DOCS}, f as (select cid, arg_min(source, doc_id) as source from d group by cid)
select source, objects_seen, raw_bytes, coalesce(objects_written, 0) as objects_written, objects_seen - coalesce(objects_written, 0) as objects_deduplicated
from (select source, count(*) as objects_seen, sum(size)::bigint as raw_bytes from d group by source)
left join (select source, count(*) as objects_written from f group by source) using (source)""")
def import_summary_by_source(spark, sf_dir):
    return importing.import_summary(docs_with_cid(spark, sf_dir, "source"), "source", "cid", "size", "doc_id")


@query("import_incremental_antijoin", f"""
with d as {DOCS} select cid, min(doc_id) as doc_id, arg_min(size, doc_id) as size from d
where doc_id % 2 = 1 and cid not in (select cid from d where doc_id % 2 = 0) group by cid""")
def import_incremental_antijoin(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir)
    return importing.new_contents(docs.filter("doc_id % 2 = 1"), docs.filter("doc_id % 2 = 0"), "cid", "doc_id", "size")


@query("alias_conflicts", f"select source, lang, n_chars, count(distinct cid) as contents from {DOCS} group by all having count(distinct cid) > 1")
def alias_conflicts(spark, sf_dir):
    return importing.conflicts(docs_with_cid(spark, sf_dir, "source", "lang", "n_chars"), ["source", "lang", "n_chars"], "cid")


@query("alias_lookup_join", f"""
with d as {DOCS}, l as (select cid, min(doc_id) as location from d group by cid) select doc_id, cid, location from d join l using (cid)""")
def alias_lookup_join(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir)
    return docs.join(docs.groupBy("cid").agg(F.min("doc_id").alias("location")), "cid").select("doc_id", "cid", "location")


@query("alias_missing_antijoin", f"""
with d as {DOCS} select doc_id, cid from d where source = 'src1' and cid not in (select cid from d where source <> 'src1')""")
def alias_missing_antijoin(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir, "source")
    return importing.missing(docs.filter("source = 'src1'"), docs.filter("source <> 'src1'"), "cid").select("doc_id", "cid")


@query("cross_repo_dedup", f"select cid, count(distinct source) as repositories, count(*) as copies from {DOCS} group by cid having count(distinct source) >= 2")
def cross_repo_dedup(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir, "source").groupBy("cid", "source").agg(F.count("*").alias("n"))
    return docs.groupBy("cid").agg(F.count("*").alias("repositories"), F.sum("n").alias("copies")).filter("repositories >= 2")


RECORD = "((148 + size + 7) & ~7)::bigint"


@query("chunk_record_length", f"select doc_id, {RECORD} as record_length from {DOCS}")
def chunk_record_length(spark, sf_dir):
    size = F.octet_length(identity.utf8(F.col("text")))
    return read_table(spark, sf_dir, "documents").select("doc_id", identity.record_length(size).alias("record_length"))


@query("chunk_offsets", f"""
select doc_id, source, record_length, (64 + coalesce(sum(record_length) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as record_offset
from (select doc_id, source, {RECORD} as record_length from {DOCS})""")
def chunk_offsets(spark, sf_dir):
    docs = _records(spark, sf_dir)
    out = ordered.running_sum(docs, ["doc_id"], F.col("record_length"), "record_offset", by=["source"])
    return out.withColumn("record_offset", F.col("record_offset") + 64)


def _records(spark, sf_dir) -> DataFrame:
    size = F.octet_length(identity.utf8(F.col("text")))
    return read_table(spark, sf_dir, "documents").select("doc_id", "source", identity.record_length(size).alias("record_length"))


@query("chunk_metadata", f"""
select source, count(*) as record_count, (128 + sum({RECORD}))::bigint as sealed_length from {DOCS} group by source""")
def chunk_metadata(spark, sf_dir):
    return _records(spark, sf_dir).groupBy("source").agg(F.count("*").alias("record_count"), (F.sum("record_length") + 128).alias("sealed_length"))


@query("chunk_rotation", f"""
with recursive d as (select source, doc_id, {RECORD} as n, row_number() over (partition by source order by doc_id) as i from {DOCS}),
r as (select source, doc_id, n, i, 0::bigint as chunk, 64::bigint as chunk_offset from d where i = 1
  union all select d.source, d.doc_id, d.n, d.i,
    case when r.chunk_offset + r.n + d.n + 64 > 32768 then r.chunk + 1 else r.chunk end, case when r.chunk_offset + r.n + d.n + 64 > 32768 then 64 else r.chunk_offset + r.n end
  from r join d on d.source = r.source and d.i = r.i + 1)
select doc_id, source, n as record_length, chunk, chunk_offset from r""")
def chunk_rotation(spark, sf_dir):
    return importing.rotate(_records(spark, sf_dir), "source", "doc_id", "record_length", 32768)


# ---- location rebuild ---------------------------------------------------------------

LOCATIONS = """(select l_partkey as content, case when l_returnflag = 'N' then 8 when l_returnflag = 'A' then 6 else 7 end as generation, l_orderkey as chunk_id,
  l_linenumber as slot, l_suppkey, round(l_extendedprice * 100)::bigint as cents from lineitem)"""
WINNERS = f"""(select content, generation, chunk_id, slot, l_suppkey, cents from {LOCATIONS}
  qualify row_number() over (partition by content order by (generation <> 8), generation, chunk_id, slot, l_suppkey, cents) = 1)"""


def _locations(spark, sf_dir) -> DataFrame:
    generation = F.when(F.col("l_returnflag") == "N", 8).when(F.col("l_returnflag") == "A", 6).otherwise(7)
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("content"), generation.alias("generation"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("slot"),
        "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )


def winners(locations: DataFrame, current: int = 8) -> DataFrame:
    """One location per content: the current generation's first, else the smallest; a map-side minimum."""
    order = F.struct((F.col("generation") != current).alias("old"), "generation", "chunk_id", "slot", "l_suppkey", "cents")
    return locations.groupBy("content").agg(F.min(order).alias("w")).select("content", "w.generation", "w.chunk_id", "w.slot", "w.l_suppkey", "w.cents")


@query("rebuild_winner", f"select * from {WINNERS}")
def rebuild_winner(spark, sf_dir):
    return winners(_locations(spark, sf_dir))


@query("rebuild_report", f"""
select count(*) as scanned, count(distinct content) as selected, count(*) - count(distinct content) as duplicates, count(*) filter (generation = 8) as current_generation from {LOCATIONS}""")
def rebuild_report(spark, sf_dir):
    per = _locations(spark, sf_dir).groupBy("content").agg(F.count("*").alias("n"), F.count_if(F.col("generation") == 8).alias("c"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.count("*").alias("selected"), F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("c"), F.lit(0)).alias("current_generation"))


@query("rebuild_batches", f"select content, ((row_number() over (order by content) - 1) // 1024)::bigint as batch from {WINNERS}")
def rebuild_batches(spark, sf_dir):
    out = ordered.row_number(winners(_locations(spark, sf_dir)).select("content"), ["content"], "n")
    return out.select("content", F.floor((F.col("n") - 1) / 1024).cast("long").alias("batch"))


@query("compaction_strict_order", f"""
select count(*) as violations from (select cid, lag(cid) over (order by source, doc_id) as prior from {DOCS}) where prior >= cid""")
def compaction_strict_order(spark, sf_dir):
    """How often a list of contents as they were imported, source by source, is not strictly ascending."""
    rows = ordered.row_number(docs_with_cid(spark, sf_dir, "source"), ["source", "doc_id"], "place")
    return maintenance.order_faults(rows, "place", "cid").agg(F.count("*").alias("violations"))


@query("compaction_shadow_locations", f"""
with d as (select cid, min(size) as size from {DOCS} group by cid), r as (select cid, {RECORD} as record_length from d)
select cid, record_length, (64 + coalesce(sum(record_length) over (order by cid rows between unbounded preceding and 1 preceding), 0))::bigint as record_offset from r""")
def compaction_shadow_locations(spark, sf_dir):
    live = docs_with_cid(spark, sf_dir).groupBy("cid").agg(F.min("size").alias("size"))
    live = live.select("cid", identity.record_length(F.col("size")).alias("record_length"))
    out = ordered.running_sum_by_digest(live, "cid", F.col("record_length"), "record_offset")
    return out.withColumn("record_offset", F.col("record_offset") + 64)


@query("manifest_counter_identity", f"""
with d as {DOCS}, f as (select cid, arg_min(source, doc_id) as source from d group by cid),
s as (select source, count(*) as seen from d group by source), w as (select source, count(*) as written from f group by source),
p as (select source, count(*) filter (doc_id <> first_id) as deduplicated from (select doc_id, source, min(doc_id) over (partition by cid) as first_id from d) group by source)
select s.source, seen, coalesce(written, 0) as written, deduplicated, seen = coalesce(written, 0) + deduplicated as holds from s left join w using (source) join p using (source)""")
def manifest_counter_identity(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir, "source")
    first = F.min("doc_id").over(Window.partitionBy("cid"))
    per = docs.withColumn("first_id", first).groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if(F.col("doc_id") == F.col("first_id")).alias("written"), F.count_if(F.col("doc_id") != F.col("first_id")).alias("deduplicated"))
    return per.withColumn("holds", F.col("seen") == F.col("written") + F.col("deduplicated"))
