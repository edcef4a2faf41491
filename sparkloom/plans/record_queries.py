"""Registered queries on symbol records, edits, stores and logs, each with its SQL for comparison where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import edits, markdown, records, replace, stores
from sparkloom.sources.corpus import bounded_files as bounded
from sparkloom.sources.corpus import files, table
from sparkloom.sources.corpus import read_multiple as read_many

#: Parts as symbols of 40 files; suppliers' line items as relations between them; events as backups and as states of tasks.
SYMBOLS_SQL = "s as (select p_partkey as symbol_id, 'f' || p_partkey % 40 as path, p_partkey // 40 as start, p_partkey // 40 + p_size as \"end\", ['structural', 'scope-resolved', 'project-resolved'][p_partkey % 3 + 1] as evidence, 'l' || p_partkey % 4 as language, p_name as name, ' ' || p_type as kind, p_type || '.' || p_name as qualified, md5(p_name) as fingerprint, p_partkey // 3 as parent_id from part)"
EDGES_SQL = "e as (select l_partkey as src, l_suppkey as tgt, ['structural', 'scope-resolved', 'project-resolved'][l_linenumber % 3 + 1] as evidence, case when l_quantity > 25 then 'resolved' else 'ambiguous' end as resolution from lineitem)"
BACKUPS_SQL = "m as (select event_id as backup_id, user_id as target, ts as created_at, event_id % 6 = 0 as pinned, md5(cast(event_id % 1000 // 7 as varchar)) as digest from events), o as (select md5(cast(c_custkey as varchar)) as digest, md5(cast(c_custkey + case when c_custkey % 11 = 0 then 1 else 0 end as varchar)) as actual, c_custkey as size from customer)"
STATES = ["queued", "starting", "running", "succeeded", "failed"]
STATES_SQL = f"t as (select user_id as task_id, event_id as revision, {STATES}[event_id % 7 % 5 + 1] as status from events)"
F_SQL = "f as (select source || '/' || doc_id || '.' || lang as path, doc_id, text from documents)"


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    at = F.floor(k / 40)
    return table(spark, d, "part").select(k.alias("symbol_id"), F.concat(F.lit("f"), (k % 40).cast("string")).alias("path"), at.alias("start"), (at + F.col("p_size")).alias("end"), _pick(list(records.EVIDENCE), k % 3).alias("evidence"), F.concat(F.lit("l"), (k % 4).cast("string")).alias("language"), F.col("p_name").alias("name"), F.concat(F.lit(" "), "p_type").alias("kind"), F.concat_ws(".", "p_type", "p_name").alias("qualified"), F.md5(F.col("p_name").cast("binary")).alias("fingerprint"), F.floor(k / 3).alias("parent_id"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("tgt"), _pick(list(records.EVIDENCE), F.col("l_linenumber") % 3).alias("evidence"), F.when(F.col("l_quantity") > 25, "resolved").otherwise("ambiguous").alias("resolution"))


def _backups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text_md5 = lambda c: F.md5(c.cast("string").cast("binary"))
    e, c = F.col("event_id"), F.col("c_custkey")
    manifests = table(spark, d, "events").select(e.alias("backup_id"), F.col("user_id").alias("target"), F.col("ts").alias("created_at"), (e % 6 == 0).alias("pinned"), text_md5(F.floor(e % 1000 / 7)).alias("digest"))
    objects = table(spark, d, "customer").select(text_md5(c).alias("digest"), text_md5(c + F.when(c % 11 == 0, 1).otherwise(0)).alias("actual"), c.alias("size"))
    return manifests, objects


def symbol_find(spark: SparkSession, d: str) -> DataFrame:
    found = records.symbol_matches(F.col("name"), F.col("qualified"), "s", "prefix") & records.of_kinds(F.col("kind"), ["Economy", " promo "])
    return _symbols(spark, d).where(found).select("symbol_id", "path", "name", "qualified")


def structural_search(spark: SparkSession, d: str) -> DataFrame:
    return records.structural_search(_symbols(spark, d), "widget", "contains", [], ["structural", "project-resolved"], 100).select("place", "path", "symbol_id", "evidence", "name", "occurrence", "truncated")


def symbol_order(spark: SparkSession, d: str) -> DataFrame:
    named = _symbols(spark, d).withColumns({"name_start": F.col("start"), "name_end": F.col("start") + 1})
    return records.top(named, ["path", *records.SOURCE_ORDER], 60).select("place", "path", "symbol_id")


def symbol_parents(spark: SparkSession, d: str) -> DataFrame:
    return records.with_parents(_symbols(spark, d))


def reference_candidates(spark: SparkSession, d: str) -> DataFrame:
    """References by qualified name and size: few namesakes each, so that none goes beyond the limit."""
    s = _symbols(spark, d).withColumn("name", F.concat_ws("#", "qualified", "end"))
    return records.candidates(s.select(F.col("symbol_id").alias("ref_id"), "name", "path"), s, ["economy", "promo"])


def paired_definitions(spark: SparkSession, d: str) -> DataFrame:
    s = _symbols(spark, d).withColumn("key", F.concat_ws("#", "qualified", F.col("end") - F.col("start")))
    return records.paired_definitions(s.where("symbol_id % 2 = 0"), s.where("symbol_id % 2 = 1"), "key")


def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return records.merge_parallel(_edges(spark, d))


def relation_page(spark: SparkSession, d: str) -> DataFrame:
    e, s = _edges(spark, d), _symbols(spark, d)
    side = lambda end: s.select(F.col("symbol_id").alias(f"{end}_symbol"), F.col("path").alias(f"{end}_path"), F.col("qualified").alias(f"{end}_qualified"))
    named = e.select(F.col("src").alias("src_symbol"), F.col("tgt").alias("tgt_symbol"), F.when(F.col("resolution") == "resolved", "inherits").otherwise("calls").alias("kind")).join(side("src"), "src_symbol").join(side("tgt"), "tgt_symbol")
    return records.relations(named, ["inherits", "extends"], 100).select("place", "src_path", "tgt_path", "src_symbol", "tgt_symbol", "occurrence", "truncated")


def context_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every part as a target, with its suppliers' and line items' parts around it, in 400 bytes and 12 items."""
    s = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size").cast("bigint") * 4).alias("body"), (F.length("p_name") * 2).cast("bigint").alias("signature"))
    edges = _edges(spark, d).select("src", "tgt")
    edges = records.spread(edges, edges.count(), "src", "tgt")
    return records.plan_context(s.select(F.col("symbol_id").alias("request_id"), "symbol_id"), edges.distinct(), s, 400, 12)


def bounded_files(spark: SparkSession, d: str) -> DataFrame:
    return bounded(files(spark, d), 50)


def read_multiple(spark: SparkSession, d: str) -> DataFrame:
    """Each document asks for itself, a missing file and itself again."""
    own = files(spark, d)
    asked = own.select(F.col("doc_id").alias("request_id"), F.array("path", F.concat("path", F.lit("~")), "path").alias("paths"))
    return read_many(asked, own).select("request_id", "place", "path", F.octet_length("text").alias("size"), "error")


def unrepresentable(spark: SparkSession, d: str) -> DataFrame:
    return edits.unrepresentable(table(spark, d, "documents"), "ascii", "doc_id")


def positions(spark: SparkSession, d: str) -> DataFrame:
    """The position of the byte after half of a document's characters."""
    docs = table(spark, d, "documents").where("text is not null")
    offset = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    return docs.select("doc_id", "text", offset.alias("offset")).select("doc_id", "offset", edits.position(F.col("text"), F.col("offset")).alias("p")).select("doc_id", "offset", "p.line", "p.column")


def patch_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each document against one whose lines with an `e` are doubled: the diff, and whether the old text patched is the new one."""
    new = F.array_join(F.flatten(F.transform(F.split("text", "\n"), lambda line: F.when(line.contains("e"), F.array(line, F.upper(line))).otherwise(F.array(line)))), "\n")
    both = table(spark, d, "documents").select("doc_id", "text", new.alias("new"))
    diffs = both.withColumn("diff", edits.unified_diff("text", "new", F.col("doc_id").cast("string"))).where("diff <> ''")
    applied = edits.apply_patches(diffs, "text", "diff")
    return applied.select("doc_id", F.regexp_count("diff", F.lit(r"(?m)^@@ ")).alias("n_hunks"), (F.col("got.text") == F.col("new")).alias("same"), F.col("got.error").alias("error"))


def edit_cascade(spark: SparkSession, d: str) -> DataFrame:
    """In each document, its second and third line as they are, indented, with other letters or absent, replaced: how and where."""
    docs = table(spark, d, "documents")
    pair = F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n")
    changed = F.when(F.col("doc_id") % 4 == 0, pair).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("  "), pair, F.lit("\t"))).when(F.col("doc_id") % 4 == 2, F.regexp_replace(pair, "a", "o")).otherwise("nothing like\nit")
    asked = docs.select("doc_id", "text", changed.alias("old"), F.lit("new line\n  and another").alias("new"))
    made = replace.replace_text(asked, "text", "old", "new", 0.8)
    return made.select("doc_id", "got.how", "got.ln", F.round("got.score", 9).alias("score"), "got.error", F.sha2("got.text", 256).alias("digest"))


def backup_status(spark: SparkSession, d: str) -> DataFrame:
    return stores.status(*_backups(spark, d))


def backup_history(spark: SparkSession, d: str) -> DataFrame:
    return stores.history(_backups(spark, d)[0])


def backup_page(spark: SparkSession, d: str) -> DataFrame:
    return stores.newest(_backups(spark, d)[0], 40, ("2024-01-10 00:00:00", 100)).select("backup_id", "target")


def backup_audit(spark: SparkSession, d: str) -> DataFrame:
    return stores.audit(*_backups(spark, d))


def task_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return stores.invalid_transitions(table(spark, d, "events").select(F.col("user_id").alias("task_id"), e.alias("revision"), _pick(STATES, e % 7 % 5).alias("status")))


def bounded_logs(spark: SparkSession, d: str) -> DataFrame:
    """All properties of a user's events as a log of 4,200 bytes."""
    chunks = table(spark, d, "events").select("user_id", "event_id", F.repeat("props", 9).cast("binary").alias("payload"))
    kept = stores.bounded_log(chunks, "user_id", "event_id", 4200)
    return kept.select("user_id", "total", F.md5("head").alias("head"), F.md5("tail").alias("tail"))


def _workspace(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown files in folders by id: every seventh line a heading, fences, links to other files in between."""
    k = F.col("doc_id")

    def marked(line: Column, i: Column) -> Column:
        link = F.concat(line, F.lit(" `[no](x)` ![no](y.png) [n](../m"), ((k + i) % 7).cast("string"), F.lit("/"), (k + i).cast("string"), F.lit('.md#part "t") [m](#'), F.lit("part-"), (i % 3).cast("string"), F.lit(")"))
        fence = F.when(i % 2 == 0, "```").otherwise("~~~~")
        return F.when(i % 7 == 0, F.concat(F.repeat(F.lit("#"), i % 3 + 1), F.lit(" "), line)).when(i % 7 == 3, F.concat(F.lit("## Part "), F.repeat(F.lit("#"), i % 2))).when(i % 9 == 4, fence).when(i % 5 == 1, link).otherwise(line)

    lines = F.transform(F.split("text", "\n"), marked)
    path = F.concat(F.lit("m"), (k % 7).cast("string"), F.lit("/"), k.cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select(k.alias("doc_id"), path.alias("path"), F.array_join(lines, "\n").alias("text"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return markdown.sections(_workspace(spark, d))


def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    return markdown.links(_workspace(spark, d))


def markdown_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return markdown.diagnostics(_workspace(spark, d), ["m0/0.md"])


QUERIES = {q.__name__: q for q in (symbol_find, structural_search, symbol_order, symbol_parents, reference_candidates, paired_definitions, merged_edges, relation_page, context_plan, bounded_files, read_multiple, unrepresentable, positions, patch_round_trip, edit_cascade, backup_status, backup_history, backup_page, backup_audit, task_transitions, bounded_logs, markdown_sections, markdown_links, markdown_diagnostics)}

_SEARCH = 'path, start, "end", symbol_id, evidence, language, name, kind, qualified, fingerprint'
_RELATION = "src_path, tgt_path, src_symbol, tgt_symbol, src_qualified, tgt_qualified, kind"
#: The workspace's texts, read line by line: fences one after the other, headings with their ends and names, links of lines.
_MD = r"""
t as (select 'm' || doc_id % 7 || '/' || doc_id || '.md' as path, list_transform(string_split(text, chr(10)), lambda line, j: case
    when (j - 1) % 7 = 0 then repeat('#', ((j - 1) % 3 + 1)::int) || ' ' || line when (j - 1) % 7 = 3 then '## Part ' || repeat('#', ((j - 1) % 2)::int)
    when (j - 1) % 9 = 4 then case when (j - 1) % 2 = 0 then '```' else '~~~~' end
    when (j - 1) % 5 = 1 then line || ' `[no](x)` ![no](y.png) [n](../m' || (doc_id + j - 1) % 7 || '/' || (doc_id + j - 1) || '.md#part "t") [m](#part-' || (j - 1) % 3 || ')' else line end) as own from documents),
l as (select path, len(own) as total, unnest(own) as line, generate_subscripts(own, 1)::int as ln from t),
f as (select path, ln, regexp_extract(line, '^ {0,3}(`+|~+)', 1) as mark, row_number() over (partition by path order by ln) as n from l where regexp_matches(line, '^ {0,3}(?:`{3,}[^`]*|~{3,}.*)$')),
s(path, n, ln, mark) as (
  select path, n, ln, mark from f where n = 1 union all
  select f.path, f.n, f.ln, case when s.mark = '' then f.mark when starts_with(f.mark, s.mark) then '' else s.mark end from s join f on f.path = s.path and f.n = s.n + 1),
o as (select l.* from l asof left join s on l.path = s.path and l.ln >= s.ln where coalesce(s.mark, '') = '' and not regexp_matches(line, '^ {0,3}(?:`{3,}[^`]*|~{3,}.*)$')),
h as (select path, total, ln, length(regexp_extract(line, '^ {0,3}(#+)', 1))::int as level, regexp_replace(regexp_extract(line, '^ {0,3}#+[ \t]*(.*)$', 1), '(?:^|[ \t]+)#*[ \t]*$', '') as title from o where regexp_matches(line, '^ {0,3}#{1,6}(?:[ \t]|$)')),
g as (select *, replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\- ]', '', 'g'), ' ', '-') as slug from h),
x as (select *, row_number() over (partition by path, slug order by ln) - 1 as again from g),
sections as (select path, ln, coalesce((select min(y.ln) - 1 from h y where y.path = x.path and y.ln > x.ln and y.level <= x.level), total)::int as end_ln, level, title,
  (select max(y.ln) from h y where y.path = x.path and y.ln < x.ln and y.level < x.level) as parent_ln, slug || case when again > 0 then '-' || again else '' end as fragment from x),
k as (select path, ln, unnest(regexp_extract_all(regexp_replace(regexp_replace(line, '`[^`]*`', '', 'g'), '!\[[^\]]*\]\([^()]*\)', '', 'g'), '\[[^\]]*\]\(([^) ]*)', 1)) as href from o where contains(line, '](')),
links as (select path, ln, case when starts_with(href, '#') then path else regexp_replace(split_part(href, '#', 1), '^\.\./', '') end as target, split_part(href, '#', 2) as fragment from k)
"""
ORACLE_SQL = {
    "markdown_sections": f"with recursive {_MD} select * from sections",
    "markdown_links": f"with recursive {_MD} select * from links",
    "markdown_diagnostics": f"with recursive {_MD} select path, ln, 'missing_document' as kind, target as detail from links where target not in (select path from t) union all select path, ln, 'missing_fragment', target || '#' || fragment from links where target in (select path from t) and (target, fragment) not in (select path, fragment from sections) union all select path, null, 'orphan', '' from t where path <> 'm0/0.md' and path not in (select target from links where path <> target)",
    "symbol_find": f"with {SYMBOLS_SQL} select symbol_id, path, name, qualified from s where (starts_with(name, 's') or starts_with(qualified, 's')) and lower(trim(kind)) in ('economy', 'promo')",
    "structural_search": f"with {SYMBOLS_SQL}, h as (select * from s where name <> '' and contains(name, 'widget') and evidence in ('structural', 'project-resolved')), r as (select *, row_number() over (order by {_SEARCH}) as place, count(*) over () > 100 as truncated, row_number() over (partition by {_SEARCH}) as occurrence from h) select cast(place as int) as place, path, symbol_id, evidence, name, cast(occurrence as int) as occurrence, truncated from r where place <= 100",
    "symbol_order": f'with {SYMBOLS_SQL}, r as (select *, row_number() over (order by path, start, "end", symbol_id) as place from s) select cast(place as int) as place, path, symbol_id from r where place <= 60',
    "symbol_parents": f"with {SYMBOLS_SQL} select s.path, s.symbol_id, s.name, p.name as parent from s left join s p on s.path = p.path and s.parent_id = p.symbol_id",
    "reference_candidates": f"""with {SYMBOLS_SQL}, n as (select *, qualified || '#' || "end" as full_name from s) select a.symbol_id as ref_id, cast(count(distinct b.symbol_id) as bigint) as n, min(b.symbol_id) as first from n a join n b on a.full_name = b.full_name and a.path <> b.path where lower(trim(b.kind)) in ('economy', 'promo') group by 1""",
    "paired_definitions": f"""with {SYMBOLS_SQL}, n as (select *, qualified || '#' || ("end" - start) as key from s), c as (select key, count(*) filter (where symbol_id % 2 = 0) as h, count(*) filter (where symbol_id % 2 = 1) as d, min(symbol_id) filter (where symbol_id % 2 = 0) as hid, min(symbol_id) filter (where symbol_id % 2 = 1) as did from n group by key) select key, case when h = 1 and d = 1 then hid end as header_id, case when h = 1 and d = 1 then did end as definition_id, case when h = 1 and d = 1 then 'resolved' else 'ambiguous' end as resolution from c where h > 0 and d > 0""",
    "merged_edges": f"with {EDGES_SQL} select src, tgt, ['structural', 'scope-resolved', 'project-resolved'][min(case evidence when 'structural' then 1 when 'scope-resolved' then 2 else 3 end)] as evidence, case when count(distinct resolution) = 1 then min(resolution) else 'ambiguous' end as resolution from e group by src, tgt",
    "relation_page": f"with {SYMBOLS_SQL}, {EDGES_SQL}, j as (select a.path as src_path, b.path as tgt_path, e.src as src_symbol, e.tgt as tgt_symbol, a.qualified as src_qualified, b.qualified as tgt_qualified, 'inherits' as kind from e join s a on a.symbol_id = e.src join s b on b.symbol_id = e.tgt where resolution = 'resolved'), r as (select *, row_number() over (order by {_RELATION}) as place, row_number() over (partition by {_RELATION}) as occurrence, count(*) over () > 100 as truncated from j) select cast(place as int) as place, src_path, tgt_path, src_symbol, tgt_symbol, cast(occurrence as int) as occurrence, truncated from r where place <= 100",
    "context_plan": "with recursive s as (select p_partkey as symbol_id, case when p_partkey % 5 > 0 then cast(p_size as bigint) * 4 end as body, cast(length(p_name) * 2 as bigint) as signature from part), e as (select distinct l_partkey as src, l_suppkey as tgt from lineitem), t as (select symbol_id as request_id, symbol_id, 0 as priority from s union all select src, tgt, 1 from e union all select tgt, src, 2 from e), i as (select request_id, symbol_id, min(priority) as priority from t where request_id in (select symbol_id from s) group by all), p as (select i.*, body, signature, row_number() over (partition by request_id order by priority, symbol_id) as rn from i join s using (symbol_id)), w as (select request_id, 0 as rn, cast(0 as bigint) as symbol_id, 0 as priority, cast(null as varchar) as part, cast(0 as bigint) as used, 0 as n, false as truncated from p where rn = 1 union all select p.request_id, p.rn, p.symbol_id, p.priority, case when n < 12 and p.body <= 400 - used then 'body' when n < 12 and p.signature <= 400 - used then 'signature' end, used + case when n < 12 and p.body <= 400 - used then p.body when n < 12 and p.signature <= 400 - used then p.signature else 0 end, n + case when n < 12 and (p.body <= 400 - used or p.signature <= 400 - used) then 1 else 0 end, not coalesce(n < 12 and (p.body <= 400 - used or (p.body is null and p.signature <= 400 - used)), false) from w join p on p.request_id = w.request_id and p.rn = w.rn + 1) select request_id, symbol_id, cast(priority as int) as priority, part, used, truncated from w where rn > 0",
    "bounded_files": f"with {F_SQL}, r as (select distinct path from f), c as (select path, row_number() over (order by path) as place, count(*) over () > 50 as truncated from r) select path, truncated from c where place <= 50",
    "read_multiple": f"with {F_SQL} select doc_id as request_id, cast(k as int) as place, case when k = 1 then path || '~' else path end as path, case when k <> 1 then cast(strlen(text) as int) end as size, case when k = 1 then 'NOT_FOUND' end as error from f, (values (0), (1), (2)) v(k)",
    "unrepresentable": "with l as (select doc_id, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from documents), c as (select doc_id, line, unnest(regexp_extract_all(body, '(?s).')) as char, generate_subscripts(regexp_extract_all(body, '(?s).'), 1) as col from l), h as (select *, count(*) over (partition by doc_id) as total, row_number() over (partition by doc_id order by line, col) as rn from c where unicode(char) > 127) select doc_id, cast(total as int) as total, cast(line as int) as line, cast(col as int) as \"column\", char, printf('U+%04X', unicode(char)) as code from h where rn <= 64",
    "positions": "with p as (select doc_id, substr(text, 1, length(text) // 2) as head from documents where text is not null) select doc_id, cast(strlen(head) as int) as \"offset\", cast(len(string_split(head, chr(10))) as int) as line, cast(length(string_split(head, chr(10))[-1]) + 1 as int) as \"column\" from p",
    "backup_status": f"with {BACKUPS_SQL} select (select count(*) from m) as manifests, (select count(*) from m where pinned) as pinned, (select count(*) from o) as objects, (select cast(sum(size) as bigint) from o) as object_bytes",
    "backup_history": f"with {BACKUPS_SQL} select target, backup_id, cast(row_number() over w as int) as version, case when lead(digest) over w is null then 'first' when lead(digest) over w = digest then 'same' else 'changed' end as change from m window w as (partition by target order by created_at desc, backup_id desc)",
    "backup_page": f"with {BACKUPS_SQL} select backup_id, target from m where (created_at, backup_id) < (timestamp '2024-01-10 00:00:00', 100) order by created_at desc, backup_id desc limit 40",
    "backup_audit": f"with {BACKUPS_SQL} select backup_id, m.digest, case when o.digest is null then 'missing' else 'damaged' end as problem from m left join o on m.digest = o.digest where o.digest is null or o.actual <> m.digest",
    "task_transitions": f"with {STATES_SQL}, w as (select *, lag(status) over (partition by task_id order by revision) as was from t) select task_id, revision, was, status from w where not coalesce(was is null and status = 'queued' or was = 'queued' and status in ('starting', 'cancelled', 'failed') or was = 'starting' and status in ('running', 'queued', 'failed', 'interrupted') or was = 'running' and status in ('succeeded', 'failed', 'timed_out', 'cancelled', 'interrupted'), false)",
    "bounded_logs": "with a as (select user_id, string_agg(repeat(props, 9), '' order by event_id) as log from events group by user_id) select user_id, cast(strlen(log) as bigint) as total, md5(substr(log, 1, 1050)) as head, md5(case when strlen(log) <= 4200 then substr(log, 1051) else right(log, 3150) end) as tail from a",
}
