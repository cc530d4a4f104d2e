"""Queries over encoded manifests, records and keys, and over publication and collection."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataweave.functions import identity
from strataweave.operators import backup, graph, maintenance, ordered
from strataweave.plans.content import DOCS, RECORD, docs_with_cid
from strataweave.plans.hierarchy import MARKED, entries, ready_roots
from strataweave.plans.registry import query
from strataweave.session import read_table
from strataweave.sources import chunks, manifests, publication
from strataweave.sources.catalog import INCOMPLETE, READY


def _id(text):
    """An id of 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def snapshot_manifests(spark, sf_dir):
    """A snapshot manifest per source: what an import of its documents counts, a branch and a tag."""
    docs = docs_with_cid(spark, sf_dir, "source")
    per = docs.groupBy("source").agg(F.count("*").alias("seen"), F.count_distinct("cid").alias("kept"), F.sum("size").alias("raw"))
    oid = F.unhex(F.sha1(F.col("source").cast("binary")))
    ref = lambda kind, folder: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(folder), F.col("source")).cast("binary").alias("name"), F.lit(1).alias("algorithm"), oid.alias("target"))
    value = F.struct(
        _id(F.col("source")).alias("repository"), _id(F.concat(F.col("source"), F.lit("/1"))).alias("snapshot_id"), F.lit(1).alias("native_object_format"), F.lit(1).alias("import_policy"), F.lit(7).cast("long").alias("imported_unix_secs"),
        F.col("seen").alias("objects_seen"), F.col("kept").alias("objects_written"), (F.col("seen") - F.col("kept")).alias("objects_deduplicated"), F.col("raw").alias("raw_bytes"), F.lit(b"one").alias("tool_version"),
        F.array(ref(1, "refs/heads/"), ref(2, "refs/tags/")).alias("refs"), F.array(F.struct(F.lit(5).alias("tag"), F.col("source").cast("binary").alias("value"))).alias("optional_fields"),
    )
    return per.select("source", manifests.encoded(value, manifests.SNAPSHOT).alias("record"))


@query("manifest_roundtrip", f"""
with p as (select source, count(*) as seen, count(distinct cid) as kept, sum(size)::bigint as raw from {DOCS} group by source)
select source, (96 + 3 + 2 * 25 + 21 + 6 + 3 * octet_length(encode(source)))::bigint as record_bytes, md5(source) as repository, seen as objects_seen, kept as objects_written, seen - kept as objects_deduplicated,
  raw as raw_bytes, 'refs/heads/' || source as branch, sha1(source) as target, 5 as tag from p""")
def manifest_roundtrip(spark, sf_dir):
    """Snapshot manifests, encoded and decoded again."""
    out = snapshot_manifests(spark, sf_dir).withColumn("d", manifests.decoded(F.col("record"), manifests.SNAPSHOT)).filter("d.error is null")
    v = F.col("d.value")
    return out.select(
        "source", F.octet_length("record").cast("long").alias("record_bytes"), F.lower(F.hex(v["repository"])).alias("repository"), v["objects_seen"].alias("objects_seen"), v["objects_written"].alias("objects_written"),
        v["objects_deduplicated"].alias("objects_deduplicated"), v["raw_bytes"].alias("raw_bytes"), v["refs"][0]["name"].cast("string").alias("branch"), F.lower(F.hex(v["refs"][1]["target"])).alias("target"), v["optional_fields"][0]["tag"].alias("tag"),
    )


@query("snapshot_publication", """
select source, case length(source) % 3 when 0 then 'ready' when 1 then 'incomplete' else 'ready' end as visibility from (select distinct source from documents)""")
def snapshot_publication(spark, sf_dir):
    """Snapshots by the length of their source's name: ready before; begun, with a damaged manifest; begun, with a whole one, which is promoted."""
    n = F.length("source") % 3
    found = snapshot_manifests(spark, sf_dir)
    key = [_id(F.col("source")).alias("repo_id"), _id(F.concat(F.col("source"), F.lit("/1"))).alias("snapshot_id")]
    snapshots = found.select("source", *key, F.when(n == 0, READY).otherwise(INCOMPLETE).alias("visibility"))
    data = F.when(n == 1, F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 1)).otherwise(F.col("record"))
    read = found.select(manifests.decoded(data, manifests.SNAPSHOT).alias("d")).select("d.value", "d.error")
    now = publication.promoted(snapshots, read).select("repo_id", "snapshot_id", F.lit(READY).alias("now"))
    out = snapshots.join(now, ["repo_id", "snapshot_id"], "left").withColumn("now", F.coalesce("now", "visibility"))
    return out.select("source", F.when(F.col("now") == READY, "ready").otherwise("incomplete").alias("visibility"))


@query("backup_manifest_decode", """
select source, doc_id // 1000 as part, source || '/' || printf('%012d', doc_id) as path, octet_length(encode(coalesce(text, '')))::bigint as bytes, sha256(coalesce(text, '')) as sha256 from documents""")
def backup_manifest_decode(spark, sf_dir):
    """Inventories of at most 1000 documents each, encoded, decoded and opened again."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit("")).cast("binary")
    path = F.concat_ws("/", "source", F.lpad(F.col("doc_id").cast("string"), 12, "0")).cast("binary")
    one = F.struct(path.alias("path"), F.octet_length(text).cast("long").alias("bytes"), F.unhex(F.sha2(text, 256)).alias("sha256"))
    per = docs.groupBy("source", F.floor(F.col("doc_id") / 1000).alias("part")).agg(F.sort_array(F.collect_list(one)).alias("files"))
    out = per.withColumn("d", manifests.decoded(manifests.encoded(F.struct("files"), manifests.BACKUP), manifests.BACKUP))
    out = out.filter("d.error is null").select("source", "part", F.explode("d.value.files").alias("f"))
    return out.select("source", "part", F.col("f.path").cast("string").alias("path"), F.col("f.bytes").alias("bytes"), F.lower(F.hex("f.sha256")).alias("sha256"))


@query("job_record_roundtrip", """
select o_orderkey, md5(o_orderkey::varchar) as id, case o_orderstatus when 'O' then 1 when 'P' then 2 else case when o_orderkey % 2 = 0 then 3 else 4 end end as state,
  case o_orderstatus when 'O' then 0 else 1 + o_orderkey % 5 end::bigint as attempts, o_orderpriority as kind, case when o_orderstatus = 'F' and o_orderkey % 2 = 1 then 'late' end as last_error,
  64 - 10 + length(o_orderpriority) + length(o_orderstatus) + case when o_orderstatus = 'F' and o_orderkey % 2 = 1 then 4 else 0 end::bigint as record_bytes from orders""")
def job_record_roundtrip(spark, sf_dir):
    """Orders as job records, encoded and decoded again."""
    o = read_table(spark, sf_dir, "orders")
    s, key = F.col("o_orderstatus"), F.col("o_orderkey")
    late = (s == "F") & (key % 2 == 1)
    state = F.when(s == "O", 1).when(s == "P", 2).when(key % 2 == 0, 3).otherwise(4)
    value = F.struct(
        state.alias("state"), _id(key.cast("string")).alias("id"), F.when(s == "O", 0).otherwise(1 + key % 5).cast("long").alias("attempts"), F.col("o_orderpriority").cast("binary").alias("kind"),
        s.cast("binary").alias("payload"), F.when(late, F.lit(b"late")).alias("last_error"),
    )
    out = o.select("o_orderkey", manifests.encoded(value, manifests.JOB).alias("record"))
    out = out.withColumn("d", manifests.decoded(F.col("record"), manifests.JOB)).filter("d.error is null")
    v = F.col("d.value")
    return out.select(
        "o_orderkey", F.lower(F.hex(v["id"])).alias("id"), v["state"].alias("state"), v["attempts"].alias("attempts"), v["kind"].cast("string").alias("kind"), v["last_error"].cast("string").alias("last_error"),
        F.octet_length("record").cast("long").alias("record_bytes"),
    )


@query("catalog_key_decode", """
select l_orderkey, l_linenumber, l_suppkey::bigint as generation, l_orderkey::bigint as chunk_id, l_partkey::bigint as record_offset, l_linenumber::bigint as flags, sha1(l_orderkey::varchar) as oid, md5(l_suppkey::varchar) as repository from lineitem""")
def catalog_key_decode(spark, sf_dir):
    """Location values and alias keys, encoded and decoded again."""
    rows = read_table(spark, sf_dir, "lineitem")
    c, zero = (lambda n: F.col(n).cast("long")), F.lit(0)
    value = identity.location_value(c("l_suppkey"), c("l_orderkey"), c("l_partkey"), zero, zero, zero, F.lit(3), F.lit(1), c("l_linenumber"), zero)
    alias = identity.alias_key(_id(F.col("l_suppkey").cast("string")), F.unhex(F.sha1(F.col("l_orderkey").cast("string").cast("binary"))), F.lit(1))
    out = rows.select("l_orderkey", "l_linenumber", identity.decoded_location(value).alias("l"), identity.decoded_alias(alias).alias("a"))
    return out.select(
        "l_orderkey", "l_linenumber", "l.generation", "l.chunk_id", F.col("l.offset").alias("record_offset"), "l.flags", F.lower(F.hex("a.oid")).alias("oid"), F.lower(F.hex("a.repository")).alias("repository"),
    )


@query("point_read_check", f"""
with d as (select cid, min(size) as size from {DOCS} group by cid), n as (select *, row_number() over (order by cid) as i from d)
select cid, case when i % 4 = 0 then 'missing' when i % 4 = 1 then 'raw_length' end as problem from n""")
def point_read_check(spark, sf_dir):
    """Locations against the records at their places, of which some were moved and some tell another length."""
    d = docs_with_cid(spark, sf_dir).groupBy("cid").agg(F.min("size").alias("size"))
    n = ordered.row_number(d, ["cid"], "i")
    length = identity.record_length(F.col("size"))
    fields = {"record_length": length, "stored_length": F.col("size"), "raw_length": F.col("size"), "kind": F.lit(3), "codec": F.lit(0), "flags": F.lit(0), "payload_crc32c": F.lit(0), "content_id": F.unhex("cid")}
    base = n.select("cid", "i", F.lit(1).alias("generation"), F.lit(1).alias("chunk_id"), (F.col("i") * 8).alias("offset"), *[v.alias(k) for k, v in fields.items()])
    records = base.select("generation", "chunk_id", "offset", *fields, F.lit(1).alias("algorithm"), F.lit(b"").alias("oid"), F.lit(b"").alias("payload"))
    told = base.withColumn("raw_length", F.col("raw_length") + F.when(F.col("i") % 4 == 1, 1).otherwise(0)).withColumn("offset", F.col("offset") + F.when(F.col("i") % 4 == 0, 4).otherwise(0))
    return chunks.records_at(records, told).select("cid", "problem")


@query("gc_run", f"""
with m as (select node, sha256(node) as cid, 148 + length(node) as used from {MARKED}), r as (select node, cid, ((used + 7) // 8 * 8)::bigint as record_length from m)
select node, record_length, (coalesce(sum(record_length) over (order by cid rows between unbounded preceding and 1 preceding), 0) // 32768)::bigint as chunk from r""")
def gc_run(spark, sf_dir):
    """The marked nodes in content order, and the chunk of the new generation that each goes to."""
    live = graph.mark(entries(spark, sf_dir).select("src", "dst"), ready_roots(spark, sf_dir), **graph.UNBOUNDED).select("node", F.sha2(F.col("node").cast("binary"), 256).alias("cid"))
    live = live.withColumn("record_length", identity.record_length(F.octet_length("node")))
    out = ordered.running_sum_by_digest(live, "cid", F.col("record_length"), "before")
    return out.select("node", "record_length", F.floor(F.col("before") / 32768).alias("chunk"))


@query("compaction_order_faults", f"""
select doc_id, cid, prior from (select doc_id, cid, lag(cid) over (order by doc_id) as prior from {DOCS}) where prior >= cid""")
def compaction_order_faults(spark, sf_dir):
    """Documents in the order of their ids are no strictly ascending list of contents; these break it."""
    return maintenance.order_faults(docs_with_cid(spark, sf_dir), "doc_id", "cid")


@query("cold_descriptor_decode", """
with c as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)
select n_regionkey, n_nationkey::bigint as chunk_id, (64 + 8 * n_nationkey)::bigint as valid_prefix, case when n_nationkey % 2 = 0 then 1 else 2 end as classification from c""")
def cold_descriptor_decode(spark, sf_dir):
    """Descriptors of the chunks of each region, encoded and decoded again, their order checked."""
    n = read_table(spark, sf_dir, "nation")
    chunk = F.struct(F.col("n_regionkey").cast("long").alias("generation"), F.col("n_nationkey").cast("long").alias("chunk_id"), F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(2).alias("classification"), (64 + 8 * F.col("n_nationkey")).cast("long").alias("valid_prefix"))
    digest = F.unhex(F.sha2(F.col("n_regionkey").cast("string").cast("binary"), 256))
    per = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    value = F.struct(F.lit(1).cast("long").alias("catalog_schema_version"), F.col("n_regionkey").cast("long").alias("active_generation"), "chunks", *[digest.alias(f"{x}_digest") for x in ("catalog", "config", "pins_manifest")])
    out = per.withColumn("d", manifests.decoded(manifests.encoded(value, manifests.COLD), manifests.COLD)).filter("d.error is null")
    out = out.select("n_regionkey", F.posexplode("d.value.chunks").alias("at", "c"))
    faults = backup.order_violations(out.select("n_regionkey", "at", "c.chunk_id"), "at", "chunk_id", by="n_regionkey").select("n_regionkey", "chunk_id")
    return out.select("n_regionkey", "c.chunk_id", "c.valid_prefix", "c.classification").join(faults, ["n_regionkey", "chunk_id"], "left_anti")
