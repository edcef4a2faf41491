"""Registered queries on graphs, stores, pages and events, each with its SQL for comparison where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import encoding, text as fx
from sparkloom.operators import analyze, graph, stores
from sparkloom.sources.corpus import table

#: Orders name parts: a graph whose edges go from larger to smaller numbers, except for some that lead back.
EDGES_SQL = "e as (select distinct l_partkey as src, l_partkey // 3 + l_suppkey % 2 as tgt from lineitem where l_partkey > 1)"
LINKS_SQL = "k as (select page_id, unnest(regexp_extract_all(html, '<a\\b[^<>]*?href=\"([^\"<>]*)\"', 1)) as href from pages)"
MANIFESTS_SQL = "m as (select event_id as backup_id, user_id as target, ts as created_at, event_id % 6 = 0 as pinned, md5(cast(event_id % 1000 as varchar)) as digest from events)"
SYMBOLS_SQL = "s as (select p_partkey as symbol_id, 'f' || p_partkey % 40 as path, 'm' || p_partkey % 8 as module, p_type as name from part), r as (select l_orderkey * 10 + l_linenumber as ref_id, 'f' || l_orderkey % 50000 as path, 'm' || l_orderkey % 10 as module, min(p_type) as name from lineitem join part on p_partkey = l_suppkey group by 1, 2, 3), i as (select distinct 'f' || l_orderkey % 50000 as src, 'f' || l_partkey % 40 as tgt, case when l_linenumber = 1 then a.p_type end as bound, case when l_linenumber = 1 then b.p_type end as leaf from lineitem left join part a on a.p_partkey = l_suppkey left join part b on b.p_partkey = l_partkey)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_partkey > 1")
    return rows.select(F.col("l_partkey").alias("src"), (F.floor(F.col("l_partkey") / 3) + F.col("l_suppkey") % 2).alias("tgt")).distinct()


def _with_back_edges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return e.union(e.where("src % 4 = 0").select("tgt", "src")).distinct()


def deps(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def dependents(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("tgt").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first"), F.max("src").alias("last"))


def reachable(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.reach(e, e.where("src between 100 and 110").select(F.col("src").alias("node")), 16).select("node", "depth")


def impact(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.impact(e, e.where("tgt = 7").select(F.col("tgt").alias("node")), 16).select("node", "depth")


def trace_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace(_edges(spark, d), 150, 1, 16)


def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycle_edges(_with_back_edges(spark, d), 64)


def point_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Line items as positions, orders as ranges in the files of their customers: a row for each line item, as line numbers repeat within an order."""
    o = table(spark, d, "orders")
    ranges = o.select(F.col("o_orderkey").alias("symbol_id"), (F.col("o_custkey") % 100).alias("path"), (F.col("o_orderkey") % 1000).alias("start"), (F.col("o_orderkey") % 1000 + F.col("o_custkey") % 50 + 1).alias("end"))
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"), (F.col("l_suppkey") % 100).alias("path"), (F.col("l_partkey") % 1000).alias("pos"))
    return graph.innermost(points, ranges)


def resolve_cascade(spark: SparkSession, d: str) -> DataFrame:
    part, item = table(spark, d, "part"), table(spark, d, "lineitem")
    name = lambda letter, key, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
    symbols = part.select(F.col("p_partkey").alias("symbol_id"), name("f", "p_partkey", 40).alias("path"), name("m", "p_partkey", 8).alias("module"), F.col("p_type").alias("name"))
    refs = item.join(part, F.col("p_partkey") == F.col("l_suppkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), name("f", "l_orderkey", 50_000).alias("path"), name("m", "l_orderkey", 10).alias("module"), F.col("p_type").alias("name"))
    kinds = lambda key, to: part.select(F.col("p_partkey").alias(key), F.col("p_type").alias(to))
    first = lambda c: F.when(F.col("l_linenumber") == 1, F.col(c)).alias(c)
    imports = item.join(kinds("l_suppkey", "bound"), "l_suppkey", "left").join(kinds("l_partkey", "leaf"), "l_partkey", "left")
    imports = imports.select(name("f", "l_orderkey", 50_000).alias("src"), name("f", "l_partkey", 40).alias("tgt"), first("bound"), first("leaf")).distinct()
    return graph.resolve_cascade(refs.groupBy("ref_id", "path", "module").agg(F.min("name").alias("name")), symbols, imports)


def resolve_dependencies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    files = docs.select(F.concat("source", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("doc_id").cast("string"), F.lit("/index.ts"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit("."), "lang"))).alias("path"))
    wanted = docs.select(F.col("doc_id").alias("ref_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("."), "lang")).otherwise("")).alias("value"))
    return graph.resolve_paths(wanted, files)


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return analyze.links(table(spark, d, "pages"))


def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return analyze.links(table(spark, d, "pages")).groupBy("href").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


def html_symbols(spark: SparkSession, d: str) -> DataFrame:
    return analyze.tag_counts(table(spark, d, "pages"))


def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of generated sources in several languages: one file for each part."""
    part = table(spark, d, "part")
    name = F.regexp_replace(F.initcap("p_name"), "[^A-Za-z]", "")
    texts = [
        ("py", F.concat(F.lit("import os\nclass "), name, F.lit(":\n    def size(self):\n        return 1\n"))),
        ("java", F.concat(F.lit("package bench;\nimport java.util.List;\npublic class "), name, F.lit(" {\n  public int size() { return 1; }\n}\n"))),
        ("go", F.concat(F.lit("package bench\nimport \"fmt\"\ntype "), name, F.lit(" struct {}\nfunc Size() int { return 1 }\n"))),
        ("ts", F.concat(F.lit("import { A } from './a';\nexport class "), name, F.lit(" extends A {}\nexport function size() {}\n"))),
        ("sql", F.concat(F.lit("create table "), name, F.lit(" (id int);\ncreate view v_"), name, F.lit(" as select 1;\n"))),
    ]
    kind = F.col("p_partkey") % len(texts)
    text, ext = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (e, t) in enumerate(texts):
        text, ext = F.when(kind == k, t).otherwise(text), F.when(kind == k, F.lit(e)).otherwise(ext)
    return analyze.symbols(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("."), ext).alias("path"), text.alias("text")))


def gc_plan(spark: SparkSession, d: str) -> DataFrame:
    return stores.gc_plan(_manifests(spark, d), 20, F.lit("2024-01-05").cast("timestamp_ntz"))


def _manifests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("backup_id"), F.col("user_id").alias("target"), F.col("ts").alias("created_at"), (F.col("event_id") % 6 == 0).alias("pinned"), F.md5((F.col("event_id") % 1000).cast("string").cast("binary")).alias("digest"))


def retention_versions(spark: SparkSession, d: str) -> DataFrame:
    return stores.versions(_manifests(spark, d)).select("target", "n_versions", "n_pinned", F.col("latest").cast("string").alias("latest"))


def orphan_objects(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "customer").select(F.md5((F.col("c_custkey") + 500).cast("string").cast("binary")).alias("digest"))
    return stores.orphans(objects, _manifests(spark, d))


def task_latest_state(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("ts").alias("revision"), "event_id")
    return stores.latest_state(events).select("task_id", "status", F.col("revision").cast("string").alias("revision"))


def task_list_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where(F.col("event_type").isin("click", "view", "purchase")).select("event_id", "event_type", F.col("ts").cast("string").alias("ts"))
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(30)


def bom_detect(spark: SparkSession, d: str) -> DataFrame:
    marks = ["EFBBBF", "FFFE", "FEFF", "FFFE0000", "0000FEFF", ""]
    mark = F.unhex(F.element_at(F.array(*map(F.lit, marks)), (F.col("doc_id") % len(marks) + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", fx.bom_type(F.concat(mark, F.col("text").cast("binary"))).alias("bom"))


def decode_legacy(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in several encodings and decoded again, strictly: (doc_id, charset, error, same)."""
    docs = table(spark, d, "documents")
    names = ["utf-8", "utf-16-le", "utf-16-be", "utf-32-le", "windows-1252", "iso-8859-15", "koi8-r"]
    charset = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    coded = docs.select("doc_id", "text", charset.alias("charset")).withColumn("coded", encoding.encode_text("text", "charset")).withColumn("decoded", encoding.decode_text("coded.content", "charset"))
    return coded.select("doc_id", "charset", F.col("coded.error").alias("error"), (F.col("decoded.text") == F.col("text")).alias("same"))


def detect_encoding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, "utf-16-le").when(F.col("doc_id") % 3 == 1, "utf-8").otherwise("utf-16-be")
    coded = docs.select("doc_id", name.alias("charset"), encoding.encode_text("text", name).alias("coded"))
    return coded.select("doc_id", "charset", encoding.detect("coded.content").alias("found")).select("doc_id", "charset", "found.*")


QUERIES = {q.__name__: q for q in (deps, dependents, reachable, impact, trace_path, cycles, point_in_range, resolve_cascade, resolve_dependencies, link_edges, backlinks, html_symbols, source_symbols, gc_plan, retention_versions, orphan_objects, task_latest_state, task_list_page, bom_detect, decode_legacy, detect_encoding)}

ORACLE_SQL = {
    "deps": f"with {EDGES_SQL} select src, tgt from e",
    "dependents": f"with {EDGES_SQL} select tgt, count(*) as n, min(src) as first, max(src) as last from e group by tgt",
    "reachable": f"with recursive {EDGES_SQL}, w(node, depth) as (select distinct src, 0 from e where src between 100 and 110 union select tgt, depth + 1 from w join e on src = node where depth < 17) select node, cast(min(depth) as int) as depth from w group by node",
    "impact": f"with recursive {EDGES_SQL}, w(node, depth) as (select cast(7 as bigint), 0 union select src, depth + 1 from w join e on tgt = node where depth < 17) select node, cast(min(depth) as int) as depth from w group by node having min(depth) > 0",
    "point_in_range": "with p as (select l_orderkey * 10 + l_linenumber as point_id, l_suppkey % 100 as path, l_partkey % 1000 as pos from lineitem), s as (select o_custkey % 100 as path, o_orderkey % 1000 as start, o_orderkey % 1000 + o_custkey % 50 + 1 as fin, min(o_orderkey) as symbol_id from orders group by all), q as (select distinct path, pos from p), b as (select q.path, q.pos, symbol_id from q join s on q.path = s.path and start <= pos and pos < fin qualify row_number() over (partition by q.path, q.pos order by start desc, fin, symbol_id) = 1) select point_id, symbol_id from p join b on p.path = b.path and p.pos = b.pos",
    "resolve_cascade": f"""
with {SYMBOLS_SQL}, q as (select distinct * from r),
j as (
  select ref_id, 1 as stage, symbol_id from q join s using (name, path)
  union select ref_id, 2, symbol_id from q join s using (name, module)
  union select ref_id, 3, symbol_id from q join i on i.src = q.path and i.bound = q.name join s on s.path = i.tgt and s.name = i.leaf
  union select ref_id, 4, symbol_id from q join i on i.src = q.path join s on s.path = i.tgt and s.name = q.name
  union select ref_id, 5, symbol_id from q join s using (name)),
b as (select ref_id, stage, count(*) as n_targets, min(symbol_id) as target from j group by ref_id, stage qualify row_number() over (partition by ref_id order by stage) = 1)
select x.ref_id, stage::int as stage, coalesce(n_targets, 0) as n_targets, case when n_targets = 1 then target end as target,
  case when n_targets = 1 then 'resolved' when n_targets > 1 then 'ambiguous' else 'unresolved' end as resolution
from (select distinct ref_id from r) x left join b using (ref_id)""",
    "resolve_dependencies": "with f as (select source || '/' || case when doc_id % 5 = 0 then doc_id || '/index.ts' else doc_id || '.' || lang end as path from documents), w as (select doc_id as ref_id, source || '/' || doc_id || case when doc_id % 3 = 0 then '.' || lang else '' end as value from documents), k as (select path, regexp_replace(path, '\\.[^./]*$', '') as stem from f), j as (select ref_id, path, 1 as rank from w join k on value = path union all select ref_id, path, 2 from w join k on value = stem union all select ref_id, path, 3 from w join k on stem = value || '/index'), b as (select * from j qualify rank = min(rank) over (partition by ref_id)) select w.ref_id, value, path, case rank when 1 then 'exact' when 2 then 'stem' when 3 then 'index' end as how from w left join b on w.ref_id = b.ref_id",
    "link_edges": f"with {LINKS_SQL} select page_id, href from k",
    "backlinks": f"with {LINKS_SQL} select href, count(*) as n_links, count(distinct page_id) as n_pages from k group by href",
    "html_symbols": "with t as (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^<>]*>', 1)) as tag from pages) select page_id, lower(tag) as tag, count(*) as n from t group by all",
    "gc_plan": f"with {MANIFESTS_SQL}, c as (select *, count(*) over (partition by target) as total, count(*) filter (where not pinned) over (partition by target) as unpinned from m), p as (select *, row_number() over (partition by target order by created_at, backup_id) as rn from c where not pinned) select target, backup_id, created_at from p where (rn <= unpinned - 20 or created_at < timestamp '2024-01-05') and total - (rn - 1) > 1",
    "retention_versions": f"with {MANIFESTS_SQL} select target, count(*) as n_versions, count(*) filter (where pinned) as n_pinned, cast(max(created_at) as varchar) as latest from m group by target",
    "orphan_objects": f"with {MANIFESTS_SQL} select md5(cast(c_custkey + 500 as varchar)) as digest from customer where md5(cast(c_custkey + 500 as varchar)) not in (select digest from m)",
    "task_latest_state": "select user_id as task_id, arg_max(event_type, row(ts, event_id)) as status, cast(max(ts) as varchar) as revision from events group by user_id",
    "task_list_page": "select event_id, event_type, cast(ts as varchar) as ts from events where event_type in ('click', 'view', 'purchase') order by ts desc, event_id desc limit 30",
    "bom_detect": "select doc_id, case doc_id % 6 when 0 then 'utf-8' when 1 then 'utf-16-le' when 2 then 'utf-16-be' when 3 then 'utf-32-le' when 4 then 'utf-32-be' else 'none' end as bom from documents",
}
