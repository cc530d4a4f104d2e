"""Trees, plans, reachability and marking over the test tables.

region, nation, customer and order form a hierarchy of trees; the turns of a
conversation form a chain of parents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.functions import paths
from strataweave.operators import graph, ordered, plan
from strataweave.plans.registry import query
from strataweave.session import read_table

ENTRIES = """(select 'root' as src, r_name as name, 'tree' as mode, 'r' || r_regionkey as dst from region
  union all select 'r' || n_regionkey, n_name, 'tree', 'n' || n_nationkey from nation
  union all select 'n' || c_nationkey, c_name, 'tree', 'c' || c_custkey from customer
  union all select 'c' || o_custkey, 'o' || o_orderkey, case when o_orderpriority like '1%' then '100755' when o_orderpriority like '2%' then '120000' else '100644' end, 'o' || o_orderkey from orders)"""
PATHS = """(select [r_name, n_name, c_name, 'o' || o_orderkey] as path, 'o' || o_orderkey as node, case when o_orderpriority like '1%' then '100755' when o_orderpriority like '2%' then '120000' else '100644' end as mode
  from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey)"""


def _id(mark: str, key: str):
    return F.concat(F.lit(mark), F.col(key).cast("string"))


def entries(spark, sf_dir) -> DataFrame:
    """src, name, mode, dst of all trees."""
    t = lambda n: read_table(spark, sf_dir, n)
    tree = F.lit("tree").alias("mode")
    mode = F.when(F.col("o_orderpriority").startswith("1"), "100755").when(F.col("o_orderpriority").startswith("2"), "120000").otherwise("100644")
    return (
        t("region").select(F.lit("root").alias("src"), F.col("r_name").alias("name"), tree, _id("r", "r_regionkey").alias("dst"))
        .unionByName(t("nation").select(_id("r", "n_regionkey").alias("src"), F.col("n_name").alias("name"), tree, _id("n", "n_nationkey").alias("dst")))
        .unionByName(t("customer").select(_id("n", "c_nationkey").alias("src"), F.col("c_name").alias("name"), tree, _id("c", "c_custkey").alias("dst")))
        .unionByName(t("orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("name"), mode.alias("mode"), _id("o", "o_orderkey").alias("dst")))
    )


def root(spark) -> DataFrame:
    return spark.range(1).select(F.lit("root").alias("node"))


def expanded(spark, sf_dir) -> DataFrame:
    return graph.expand(entries(spark, sf_dir), root(spark))


def joined(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", "/"))


@query("tree_entries_region_nation", "select r_name as tree, '40000' as mode, n_name as name, n_nationkey as child from nation join region on n_regionkey = r_regionkey")
def tree_entries_region_nation(spark, sf_dir):
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("tree"), F.lit("40000").alias("mode"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("child"))


@query("tree_expand_paths", f"select array_to_string(path, '/') as path, mode, node from {PATHS}")
def tree_expand_paths(spark, sf_dir):
    return joined(expanded(spark, sf_dir))


@query("tree_parent_directories", f"select distinct array_to_string(path[1:i], '/') as path from {PATHS}, range(1, 4) t(i)")
def tree_parent_directories(spark, sf_dir):
    return joined(plan.directories(expanded(spark, sf_dir)))


@query("plan_counts_by_mode", f"select count(*) filter (mode = '100644') as regular, count(*) filter (mode = '100755') as executable, count(*) filter (mode = '120000') as symlinks, count(*) filter (mode = '160000') as gitlinks from {PATHS}")
def plan_counts_by_mode(spark, sf_dir):
    names = {"100644": "regular", "100755": "executable", "120000": "symlinks", "160000": "gitlinks"}
    return expanded(spark, sf_dir).agg(*[F.count_if(F.col("mode") == m).alias(n) for m, n in names.items()])


@query("plan_duplicate_paths", "select c_mktsegment || '/' || c_nationkey as path, count(*) as entries from customer group by all having count(*) > 1")
def plan_duplicate_paths(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer").select(F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("path"))
    return joined(plan.duplicates(c))


PAGE_PATH = "coalesce(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '')"


@query("plan_path_conflicts", f"""
with p as (select string_split({PAGE_PATH}, '/') as path from pages union all select (string_split({PAGE_PATH}, '/'))[1:1] from pages where page_id % 3 = 0)
select distinct array_to_string(a.path, '/') as path from p a where exists (select 1 from p b where len(b.path) > len(a.path) and b.path[1:len(a.path)] = a.path)""")
def plan_path_conflicts(spark, sf_dir):
    whole = read_table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), "/", -1).alias("path"))
    some = whole.filter("page_id % 3 = 0").select(F.slice("path", 1, 1).alias("path"))
    return joined(plan.conflicts(whole.select("path").unionByName(some)))


@query("path_validation", f"""
select page_id, k, case when p = '' then 'empty' when p like '/%' then 'absolute' when octet_length(encode(p)) > 4096 then 'long_path' when len(string_split(p, '/')) > 128 then 'deep'
  else coalesce(list_filter(list_transform(string_split(p, '/'), lambda c: case when c = '' then 'empty_name' when c in ('.', '..') then 'dot_name' when octet_length(encode(c)) > 255 then 'long_name' end), lambda e: e is not null)[1], 'ok') end as error
from (select page_id, k, case k when 0 then u when 1 then '/' || u when 2 then u || '/../x' when 3 then u || '//x' when 4 then repeat('a/', 130) || 'b' when 5 then repeat('n', 256) when 6 then '' else repeat('long/', 1000) || 'b' end as p
  from (select page_id, {PAGE_PATH} as u from pages), range(8) t(k))""")
def path_validation(spark, sf_dir):
    u = F.col("u")
    forms = [u, F.concat(F.lit("/"), u), F.concat(u, F.lit("/../x")), F.concat(u, F.lit("//x")), F.lit("a/" * 130 + "b"), F.lit("n" * 256), F.lit(""), F.lit("long/" * 1000 + "b")]
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1).alias("u"))
    each = pages.select("page_id", F.posexplode(F.array(*forms)).alias("k", "p"))
    return each.select("page_id", F.col("k").cast("long").alias("k"), paths.path_error(F.col("p")).alias("error"))


@query("path_component_order", f"select array_to_string(path, '/') as path, row_number() over (order by path, node) as place from {PATHS}")
def path_component_order(spark, sf_dir):
    out = ordered.row_number(expanded(spark, sf_dir).select("path", "node"), ["path", "node"], "place")
    return joined(out.select("path", "place"))


TURNS = "(select distinct 'v' || conv_id || ':' || turn as src, 'v' || conv_id || ':' || (turn - 1) as dst from conversations where turn > 0)"


@query("commit_chain_closure", """
select 'v' || conv_id || ':' || turn as node, (max(turn) over (partition by conv_id) - turn)::int as level from (select distinct conv_id, turn from conversations)""")
def commit_chain_closure(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    node = lambda t: F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    edges = c.filter("turn > 0").select(node(F.col("turn")).alias("src"), node(F.col("turn") - 1).alias("dst"))
    heads = c.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(node(F.col("turn")).alias("node"))
    return graph.reachable(edges, heads)


@query("reachable_from_roots", f"""
with recursive r as (select 'r' || r_regionkey as node, 0 as level from region where r_regionkey < 2 union all select e.dst, level + 1 from r join {ENTRIES} e on e.src = r.node) select * from r""")
def reachable_from_roots(spark, sf_dir):
    roots = read_table(spark, sf_dir, "region").filter("r_regionkey < 2").select(_id("r", "r_regionkey").alias("node"))
    return graph.reachable(entries(spark, sf_dir).select("src", "dst"), roots)


READY = "(select distinct c_nationkey from customer where c_acctbal > 9900)"


def ready_roots(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "customer").filter("c_acctbal > 9900").select(_id("n", "c_nationkey").alias("node")).distinct()


MARKED = f"""(select 'n' || c_nationkey as node, 0 as level from {READY} union all select 'c' || c_custkey, 1 from customer where c_nationkey in {READY}
  union all select 'o' || o_orderkey, 2 from orders join customer on o_custkey = c_custkey where c_nationkey in {READY})"""


@query("gc_mark_set", f"select * from {MARKED}")
def gc_mark_set(spark, sf_dir):
    return graph.mark(entries(spark, sf_dir).select("src", "dst"), ready_roots(spark, sf_dir), **graph.UNBOUNDED)


@query("gc_sweep_unmarked", f"select c_custkey from customer where 'c' || c_custkey not in (select node from {MARKED})")
def gc_sweep_unmarked(spark, sf_dir):
    marked = graph.reachable(entries(spark, sf_dir).select("src", "dst"), ready_roots(spark, sf_dir))
    c = read_table(spark, sf_dir, "customer").select("c_custkey", _id("c", "c_custkey").alias("node"))
    return c.join(marked.select("node"), "node", "left_anti").select("c_custkey")


@query("gc_roots_union", """
select 0 as root_order, 'snapshot' as root_kind, n_nationkey::bigint as id, null::bigint as generation from nation where n_nationkey % 2 = 0
union all select 1, 'workspace_pin', s_suppkey, s_nationkey::bigint from supplier where s_acctbal > 0
union all select 2, 'explicit_pin', r_regionkey::bigint, r_regionkey::bigint from region""")
def gc_roots_union(spark, sf_dir):
    t = lambda n: read_table(spark, sf_dir, n)
    row = lambda k, n, i, g: (F.lit(k).alias("root_order"), F.lit(n).alias("root_kind"), F.col(i).cast("long").alias("id"), g.cast("long").alias("generation"))
    return (
        t("nation").filter("n_nationkey % 2 = 0").select(*row(0, "snapshot", "n_nationkey", F.lit(None)))
        .unionByName(t("supplier").filter("s_acctbal > 0").select(*row(1, "workspace_pin", "s_suppkey", F.col("s_nationkey"))))
        .unionByName(t("region").select(*row(2, "explicit_pin", "r_regionkey", F.col("r_regionkey")))).orderBy("root_order", "id", "generation")
    )


@query("gc_retire_blocked", "select n_nationkey as generation, exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal > 9000) as blocked from nation")
def gc_retire_blocked(spark, sf_dir):
    pins = read_table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("generation"), F.lit(True).alias("pin")).distinct()
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("generation"))
    return n.join(pins, "generation", "left").select("generation", F.coalesce("pin", F.lit(False)).alias("blocked"))


@query("mark_limits_check", f"""
select (select count(*) from {READY}) as roots, (select count(*) from {MARKED}) as objects, (select count(*) from {READY}) + (select count(*) from {ENTRIES} where src in (select node from {MARKED})) as "references",
  (select count(*) from {READY}) <= 4096 and (select count(*) from {MARKED}) <= 8388608 as within""")
def mark_limits_check(spark, sf_dir):
    edges, roots = entries(spark, sf_dir).select("src", "dst"), ready_roots(spark, sf_dir)
    out = graph.totals(edges, roots, graph.reachable(edges, roots))
    return out.withColumn("within", (F.col("roots") <= graph.MAX_ROOTS) & (F.col("references") <= graph.MAX_REFERENCES) & (F.col("objects") <= graph.MAX_OBJECTS))
