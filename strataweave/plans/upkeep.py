"""Cache, capacity, backup, workspace, job and event queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import identity, parsers
from strataweave.operators import backup, cache, jobs, ordered
from strataweave.plans.content import DOCS, cid_sql, docs_with_cid
from strataweave.plans.registry import query
from strataweave.session import read_table
from strataweave.streaming import events as stream

CACHE = f"(select cid, min(size)::bigint as logical_bytes from {DOCS} group by cid)"


def cache_entries(spark, sf_dir) -> DataFrame:
    return docs_with_cid(spark, sf_dir).groupBy("cid").agg(F.min("size").alias("logical_bytes"))


@query("cache_usage", f"select count(*) as entries, sum(logical_bytes)::bigint as logical_bytes from {CACHE}")
def cache_usage(spark, sf_dir):
    return cache.usage(cache_entries(spark, sf_dir))


@query("cache_fanout_path", f"select cid, cid[1:2] || '/' || cid[3:4] || '/' || cid as path from {CACHE}")
def cache_fanout_path(spark, sf_dir):
    return cache_entries(spark, sf_dir).select("cid", identity.fanout_path(F.col("cid")).alias("path"))


@query("cache_fanout_histogram", f"select cid[1:2] as prefix, count(*) as entries, sum(logical_bytes)::bigint as logical_bytes from {CACHE} group by 1")
def cache_fanout_histogram(spark, sf_dir):
    return cache_entries(spark, sf_dir).groupBy(F.substring("cid", 1, 2).alias("prefix")).agg(F.count("*").alias("entries"), F.sum("logical_bytes").alias("logical_bytes"))


@query("cache_evict_to", f"""
with c as (select *, sum(logical_bytes) over () as total, coalesce(sum(logical_bytes) over (order by cid rows between unbounded preceding and 1 preceding), 0) as before from {CACHE})
select cid, logical_bytes from c where total - before > total // 2""")
def cache_evict_to(spark, sf_dir):
    entries = cache_entries(spark, sf_dir)
    total = cache.usage(entries).first()["logical_bytes"]
    return cache.evict_to(entries, total // 2)


@query("cache_missing_hydrate", f"""
with d as {DOCS}, needed as (select distinct cid from d where lang <> 'en'), cached as (select distinct cid from d where doc_id % 3 = 0)
select needed.cid, l.doc_id as location from needed join (select cid, min(doc_id) as doc_id from d group by cid) l using (cid) where needed.cid not in (select cid from cached)""")
def cache_missing_hydrate(spark, sf_dir):
    docs = docs_with_cid(spark, sf_dir, "lang")
    needed = docs.filter("lang <> 'en'").select("cid").distinct().join(docs.filter("doc_id % 3 = 0").select("cid"), "cid", "left_anti")
    return needed.join(docs.groupBy("cid").agg(F.min("doc_id").alias("location")), "cid")


@query("capacity_admission", """
with s as (select s_suppkey, greatest(floor(s_acctbal), 0)::bigint as host, greatest(floor(10000 - s_acctbal), 0)::bigint as guest from supplier),
x as (select s_suppkey, greatest(3000 - greatest(host - 500, 0), 0)::bigint as h, greatest(2500 - greatest(guest - 500, 0), 0)::bigint as g from s)
select s_suppkey, case when h > 0 and g > 0 then 'host_and_guest' when h > 0 then 'host' when g > 0 then 'guest' else 'admitted' end as outcome, h as host_shortfall, g as guest_shortfall, greatest(h, g) as required_reclaim from x""")
def capacity_admission(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier")
    host, guest = F.greatest(F.floor("s_acctbal"), F.lit(0)), F.greatest(F.floor(10000 - F.col("s_acctbal")), F.lit(0))
    n = lambda x: F.lit(x).cast("long")
    return s.select("s_suppkey", cache.admission(host, guest, n(500), n(3000), n(2500)).alias("a")).select("s_suppkey", "a.*")


# ---- backup and workspaces --------------------------------------------------------

PAGES = "(select page_id as relative, octet_length(encode(html))::bigint as bytes, sha256(html) as sha256 from pages)"
MANIFEST = f"""(select relative, case when relative % 11 = 3 then bytes + 1 else bytes end as bytes, case when relative % 11 = 5 then sha256('x') else sha256 end as sha256 from {PAGES}
  union all select relative + 1000000, bytes, sha256 from {PAGES} where relative % 11 = 7)"""


def page_files(spark, sf_dir) -> DataFrame:
    html = F.col("html").cast("binary")
    return read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("relative"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("sha256"))


@query("backup_verify_left_join", f"""
select m.relative, case when f.relative is null then 'missing' when f.bytes <> m.bytes then 'length' else 'digest' end as problem
from {MANIFEST} m left join {PAGES} f on f.relative = m.relative where f.relative is null or f.bytes <> m.bytes or f.sha256 <> m.sha256""")
def backup_verify_left_join(spark, sf_dir):
    files = page_files(spark, sf_dir)
    r = F.col("relative") % 11
    altered = files.withColumns({"bytes": F.when(r == 3, F.col("bytes") + 1).otherwise(F.col("bytes")), "sha256": F.when(r == 5, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.col("sha256"))})
    gone = files.filter("relative % 11 = 7").withColumn("relative", F.col("relative") + 1000000)
    return backup.mismatches(altered.unionByName(gone), files).select("relative", "problem")


@query("backup_inventory_digest", f"select * from {PAGES}")
def backup_inventory_digest(spark, sf_dir):
    return page_files(spark, sf_dir)


@query("backup_descriptor_sorted", """
select l_orderkey, count(*) as violations from (select l_orderkey, row(l_partkey, l_suppkey) as k, lag(row(l_partkey, l_suppkey)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as p from lineitem) where p >= k group by l_orderkey""")
def backup_descriptor_sorted(spark, sf_dir):
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return backup.order_violations(lines, "l_linenumber", "l_partkey", "l_suppkey", by="l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("violations"))


@query("layout_full_outer", """
with a as (select distinct c_nationkey as generation, c_mktsegment as chunk from customer where c_custkey % 5 = 0), b as (select distinct c_nationkey as generation, c_mktsegment as chunk from customer where c_custkey % 7 = 0)
select generation, chunk, a.generation is not null as in_left, b.generation is not null as in_right from a full join b using (generation, chunk) where a.generation is null or b.generation is null""")
def layout_full_outer(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("generation"), F.col("c_mktsegment").alias("chunk"))
    side = lambda n: c.filter(F.col("c_custkey") % n == 0).select("generation", "chunk").distinct()
    return backup.layout_mismatches(side(5), side(7), ["generation", "chunk"])


READY = """(select c_custkey as workspace_id, c_name as name from customer join (select distinct o_custkey from orders) on o_custkey = c_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where c_acctbal > 0 and r_name <> 'ASIA')"""


def ready_workspaces(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("generation"), "c_acctbal")
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    records = c.select("workspace_id", F.md5(F.col("name").cast("binary")).alias("record_digest"))
    manifests = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace_id")).distinct().join(c, "workspace_id").select("workspace_id", "generation", F.md5(F.col("name").cast("binary")).alias("manifest_digest"))
    names = c.filter("c_acctbal > 0").select("workspace_id", "name")
    pins = c.join(n, F.col("generation") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).filter("r_name <> 'ASIA'").select("workspace_id", "generation")
    return backup.ready_workspaces(records.join(c.select("workspace_id", "name"), "workspace_id"), manifests, names, pins).select("workspace_id", "name")


@query("workspace_ready_join", f"select * from {READY}")
def workspace_ready_join(spark, sf_dir):
    return ready_workspaces(spark, sf_dir)


@query("workspace_incomplete_anti", f"select distinct o_custkey as workspace_id from orders where o_custkey not in (select workspace_id from {READY})")
def workspace_incomplete_anti(spark, sf_dir):
    manifests = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("workspace_id")).distinct()
    return manifests.join(ready_workspaces(spark, sf_dir), "workspace_id", "left_anti")


# ---- jobs and events ----------------------------------------------------------------

STATE = "case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3 when 'error' then 4 end"
OPS = {"signup": "enqueue", "view": "start", "click": "succeed", "error": "fail", "purchase": "retry"}
OUTCOME = "case when value is null or value < 0 then 'rejected' when value < 10 then 'started' when value < 50 then 'succeeded' else 'failed' end"


def _mapped(column: str, values: dict):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(column)]


def outcome():
    v = F.col("value")
    return F.when(v.isNull() | (v < 0), "rejected").when(v < 10, "started").when(v < 50, "succeeded").otherwise("failed")


@query("job_state_counts", f"select count(*) filter (s = 1) as queued, count(*) filter (s = 2) as running, count(*) filter (s = 3) as succeeded, count(*) filter (s = 4) as failed from (select {STATE} as s from events)")
def job_state_counts(spark, sf_dir):
    return jobs.state_counts(read_table(spark, sf_dir, "events").select(_mapped("event_type", {"signup": 1, "view": 2, "click": 3, "error": 4}).alias("state")))


@query("job_claim_next", "select user_id, min(event_id) as event_id from events where event_type = 'signup' group by user_id")
def job_claim_next(spark, sf_dir):
    return jobs.claim_first(read_table(spark, sf_dir, "events").filter("event_type = 'signup'"), "user_id", "event_id")


@query("job_state_replay", """
with recursive e as (select user_id, event_type as t, row_number() over (partition by user_id order by event_id) as i from events),
s(op, a, b) as (values ('signup', 0, 1), ('view', 1, 2), ('click', 2, 3), ('error', 2, 4), ('purchase', 4, 1)),
r as (select distinct user_id, 0::bigint as i, 0 as state, 0::bigint as attempts, 0::bigint as rejected from events
  union all select r.user_id, e.i, coalesce(b, state), attempts + coalesce((b = 2)::int, 0), rejected + (b is null)::int from r join e on e.user_id = r.user_id and e.i = r.i + 1 left join s on op = t and a = state)
select user_id, arg_max(state, i) as state, max(attempts) as attempts, max(rejected) as rejected from r group by user_id""")
def job_state_replay(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", _mapped("event_type", OPS).alias("op"))
    return jobs.replay(e, "user_id", ["event_id"], "op")


@query("scrub_due", """
with s as (select user_id, (epoch_us(max(ts)) // 1000000)::bigint as last, (60 + user_id * 97 % 86400)::bigint as interval_s, max(event_id) % 4 <> 0 as idle from events group by user_id), n as (select (epoch_us(max(ts)) // 1000000)::bigint as now from events)
select user_id, last + interval_s as next_due, idle and last + interval_s <= now as due from s, n""")
def scrub_due(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).select(F.unix_seconds(F.col("max(ts)").cast("timestamp"))).first()[0]
    s = e.groupBy("user_id").agg(F.unix_seconds(F.max("ts").cast("timestamp")).alias("last"), (F.max("event_id") % 4 != 0).alias("idle"))
    s = s.withColumn("every", F.lit(60) + F.col("user_id") * 97 % 86400)
    return s.select("user_id", (F.col("last") + F.col("every")).alias("next_due"), jobs.scrub_due(F.col("every"), F.col("last"), F.lit(now), F.col("idle")).alias("due"))


@query("event_metrics", f"select event_type, {OUTCOME} as outcome, count(*) as events from events group by all")
def event_metrics(spark, sf_dir):
    return stream.metrics(read_table(spark, sf_dir, "events"), outcome())


@query("event_stream_metrics", f"select event_type, {OUTCOME} as outcome, count(*) as events from events group by all")
def event_stream_metrics(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    events = stream.event_stream(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)  # a pattern, so that a single file may be the source
    return stream.drained(stream.metrics(events, outcome()), "complete", "event-metrics")


@query("event_ring_buffer", "select event_id, greatest((select count(*) from events) - 256, 0)::bigint as dropped from (select event_id from events order by ts desc, event_id desc limit 256)")
def event_ring_buffer(spark, sf_dir):
    """The last 256 events: a top-k that every task cuts before the exchange."""
    e = read_table(spark, sf_dir, "events")
    kept = e.select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(256).select("event_id")
    return kept.withColumn("dropped", F.lit(max(0, e.count() - 256)).cast("long"))


@query("event_ndjson", f"""
select event_id, '{{"version":1,"event":"job","outcome":"' || {OUTCOME} || '","job":{{"id":"' || lower(printf('%032x', event_id)) || '","state":"' || event_type || '","user":' || user_id || '}}}}' as line from events""")
def event_ndjson(spark, sf_dir):
    job = F.struct(F.lower(F.lpad(F.hex("event_id"), 32, "0")).alias("id"), F.col("event_type").alias("state"), F.col("user_id").alias("user"))
    line = F.to_json(F.struct(F.lit(1).alias("version"), F.lit("job").alias("event"), outcome().alias("outcome"), job.alias("job")))
    return read_table(spark, sf_dir, "events").select("event_id", line.alias("line"))


# ---- literals ---------------------------------------------------------------------

ID = "0123456789abcdef" * 2
COMMANDS = {
    "status": ("status", None, None), "maintenance gc": ("gc", None, None), "maintenance cache-pressure 4096": ("cache-pressure", "4096", None), "maintenance cache-pressure -1": (None, None, "invalid"),
    f"job get {ID}": ("get", ID, None), f"job start {ID}": ("start", ID, None), f"job fail {ID} 00ff": ("fail", ID, None), f"job fail {ID} 0": (None, None, "invalid"), f"job retry {ID[:-1]}": (None, None, "invalid"),
    "job enqueue 0a ": (None, None, "invalid"), "job enqueue 0a ff": ("enqueue", "0a", None), "job  get": (None, None, "invalid"), "": (None, None, "invalid"), "job list": (None, None, "unsupported"), "reboot": (None, None, "unsupported"), "status\n": (None, None, "invalid"),
}


def _values(rows: list[tuple]) -> str:
    said = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return ", ".join("(" + ", ".join(said(v) for v in r) + ")" for r in rows)


@query("command_parse", f"select * from (values {_values([(c, *r) for c, r in COMMANDS.items()])}) t(request, variant, argument, error)")
def command_parse(spark, sf_dir):
    rows = spark.createDataFrame([(c,) for c in COMMANDS], "request string")
    return rows.select("request", parsers.command(F.col("request")).alias("p")).select("request", "p.*")


QGROUPS = {"0/5 16384 16384 none none": (0, 5, 16384, 16384, None, None), "1/42  1048576 4096 2097152 none": (1, 42, 1048576, 4096, 2097152, None), "0/5 1 2 3": None, "x/5 1 2 none none": None, "0/7 1 2 -3 none": None}
TRIMS = {"/mnt: 0 B (0 bytes) trimmed": 0, "/mnt: 1.5 MiB (1572864 bytes) trimmed": 1572864, "/mnt: 2 GiB (2147483648 bytes) trimmed": 2147483648, "/mnt: x MiB": None, "": None, "/mnt: 1.1234567 KiB": None}


@query("qgroup_parse", f"select * from (values {_values([(line, *(r or (None,) * 6)) for line, r in QGROUPS.items()])}) t(line, level, subvolume, referenced, exclusive, max_referenced, max_exclusive)")
def qgroup_parse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in QGROUPS], "line string")
    return rows.select("line", parsers.qgroup_fields(F.col("line")).alias("q")).select("line", "q.*")


@query("trim_parse", f"select * from (values {_values(list(TRIMS.items()))}) t(line, bytes)")
def trim_parse(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in TRIMS], "line string")
    return rows.select("line", parsers.trim_bytes(F.col("line")).alias("bytes"))
