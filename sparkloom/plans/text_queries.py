"""Registered queries on text and files, each with its SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as fx
from sparkloom.operators import search
from sparkloom.sources.corpus import cr_framed, files, framed, lines, table

#: Lines of every document, framed as in lines(); and files with their paths.
LINES_SQL = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from documents)"
FILES_SQL = "f as (select source || '/' || doc_id || '.' || lang as path, doc_id, text from documents)"
#: The corpus has no carriage returns or trailing blanks: every third document gets CRLF, every fifth a mix, every seventh blanks.
MIXED_SQL = "m as (select doc_id, case when doc_id % 3 = 0 then replace(text, chr(10), chr(13) || chr(10)) when doc_id % 5 = 0 then text || chr(13) || chr(10) || 'x' when doc_id % 7 = 0 then replace(text, chr(10), ' ' || chr(10)) else text end as text from documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    t, i = F.col("text"), F.col("doc_id")
    changed = F.when(i % 3 == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(i % 5 == 0, F.concat(t, F.lit("\r\nx"))).when(i % 7 == 0, F.replace(t, F.lit("\n"), F.lit(" \n"))).otherwise(t)
    return _docs(spark, d).select("doc_id", changed.alias("text"))


def grep_content(spark: SparkSession, d: str) -> DataFrame:
    found = search.grep(framed(_docs(spark, d), "doc_id"), ["the", "der"], key="doc_id", before=1, after=1)
    return found.select("doc_id", "ln", "col", "text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def grep_count(spark: SparkSession, d: str) -> DataFrame:
    return search.count_matches(framed(_docs(spark, d), "doc_id"), ["and", r"\bque\b"], "doc_id")


def grep_files(spark: SparkSession, d: str) -> DataFrame:
    return search.count_matches(framed(files(spark, d), "path"), [r"\d{3}"]).select("path")


def grep_matches_only(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(framed(_docs(spark, d), "doc_id"), [r"[a-z]+ing\b"], key="doc_id", case_sensitive=False, matches_only=True).select("doc_id", "ln", "col", "text")


def grep_page(spark: SparkSession, d: str) -> DataFrame:
    found = search.grep(framed(_docs(spark, d), "doc_id"), ["de"], key="doc_id").select("doc_id", "ln", "col", "text")
    return search.page(found, ["doc_id", "ln"], 10, 25)


def grep_cr(spark: SparkSession, d: str) -> DataFrame:
    return search.count_matches(cr_framed(_mixed(spark, d), "doc_id"), ["^[A-Z]"], "doc_id")


def line_index(spark: SparkSession, d: str) -> DataFrame:
    each = framed(_docs(spark, d), "doc_id").where("own is not null")
    longest = F.array_max(F.transform("own", F.octet_length))
    return each.select("doc_id", F.size("own").cast("bigint").alias("n_lines"), longest.cast("bigint").alias("longest"), F.octet_length(F.array_join("own", "")).cast("bigint").alias("bytes"))


def read_range(spark: SparkSession, d: str) -> DataFrame:
    return search.read_range(framed(_docs(spark, d), "doc_id"), "doc_id", 2, 3)


def line_ending_style(spark: SparkSession, d: str) -> DataFrame:
    lf, crlf = fx.ending_counts(F.col("text"))
    return _mixed(spark, d).select("doc_id", lf.alias("lf"), crlf.alias("crlf"), fx.ending_style(lf, crlf).alias("style"))


def minority_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files with both endings that end in the rarer way; equal counts make the line feed the rarer one."""
    cut = F.split("text", "\n")
    ends = _mixed(spark, d).where("text is not null").select("doc_id", F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda raw, i: F.struct((i + 1).alias("ln"), raw.endswith("\r").alias("crlf"))).alias("ends"))
    counted = ends.select("doc_id", "ends", F.size("ends").alias("n"), F.size(F.filter("ends", lambda e: e["crlf"])).alias("n_crlf"))
    rare_crlf = F.col("n_crlf") < F.col("n") - F.col("n_crlf")
    both = counted.where((F.col("n_crlf") > 0) & (F.col("n_crlf") < F.col("n")))
    return both.select("doc_id", F.inline(F.filter("ends", lambda e: e["crlf"] == rare_crlf))).select("doc_id", "ln")


def convert_eol(spark: SparkSession, d: str) -> DataFrame:
    m = _mixed(spark, d)
    return m.select("doc_id", F.sha2(fx.to_lf(F.col("text")), 256).alias("lf_sha"), F.sha2(fx.to_crlf(F.col("text")), 256).alias("crlf_sha"))


def trailing_ws(spark: SparkSession, d: str) -> DataFrame:
    return lines(_mixed(spark, d), "doc_id").where(F.col("line").rlike(r"[ \t]\z")).select("doc_id", "ln")


def json_valid(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("event_id") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", fx.valid_json(broken).alias("valid"))


def binary_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth text with a control character for each vowel; every eighth only for each `z`."""
    noisy = F.when(F.col("doc_id") % 8 == 4, F.regexp_replace("text", "[aeiou]", "\x01")).when(F.col("doc_id") % 8 == 0, F.regexp_replace("text", "z", "\x02")).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", search.likely_binary(noisy).alias("is_binary"))


def byte_scalar_columns(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length("text").cast("bigint").alias("scalars"), F.octet_length("text").cast("bigint").alias("bytes"))


def common_run(spark: SparkSession, d: str) -> DataFrame:
    """Each document with the next: the longest run of common lines."""
    own = lines(_docs(spark, d), "doc_id").where("trim(line) <> ''")
    left = own.select((F.floor(F.col("doc_id") / 2)).alias("pair"), "doc_id", "ln", "line")
    return search.common_run(left.where("doc_id % 2 = 0"), left.where("doc_id % 2 = 1"), ["pair"])


def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Each document's first line, sought in all windows of its further lines; whole lines, all characters."""
    sought = _docs(spark, d).select("doc_id", "text", F.split("text", "\n")[0].alias("sought"))
    return search.fuzzy_windows(sought, "doc_id").where("ln > 1").select("doc_id", "ln", "distance", F.round("similarity", 6).alias("similarity"))


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    paths = files(spark, d).select("path")
    return paths.where(fx.glob_match(F.col("path"), "src*/**/*.en") & ~fx.excluded(F.col("path"), ["src1", "*7.en"]))


def search_topk_name(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files(spark, d).select("path", name.alias("name")).orderBy("name", "path").limit(20)


def search_topk_size(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", F.octet_length("text").cast("bigint").alias("size")).orderBy(F.desc("size"), F.desc("path")).limit(20)


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return search.after_key(orders.select("o_orderpriority", "o_orderkey"), ["o_orderpriority", "o_orderkey"], ["2-HIGH", 500], 50)


def list_directory(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select(F.split("path", "/")[0].alias("folder"), F.octet_length("text").cast("bigint").alias("size")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    """Each folder, then its files, indented by depth; sorting by place gives the preorder, as a folder is a prefix of what it holds."""
    own = files(spark, d).select("path", F.split("path", "/").alias("parts"))
    folders = own.select(F.col("parts")[0].alias("path")).distinct().select("path", F.array("path").alias("parts"))
    every = folders.unionByName(own)
    indented = F.concat(F.repeat(F.lit("  "), F.size("parts") - 1), F.element_at("parts", -1))
    return every.select("path", (F.size("parts") - 1).alias("depth"), indented.alias("entry"), F.array_join("parts", "\x01").alias("place"))


def ignore_rules(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rules, the last match wins, `!` takes a path back."""
    rules = [("**/*.de", False), ("src2", False), ("**/1*.de", True), ("src0/**", False)]
    path = F.col("path")
    match = [(fx.glob_match(path, r) if "*" in r else F.array_contains(F.split(path, "/"), r), negated) for r, negated in rules]
    ignored = F.lit(False)
    for hit, negated in match:
        ignored = F.when(hit, F.lit(not negated)).otherwise(ignored)
    return files(spark, d).select("path", ignored.alias("ignored"))


def fingerprint_docs(spark: SparkSession, d: str) -> DataFrame:
    """One digest of each folder: of its files' paths and content digests, in order."""
    each = files(spark, d).select(F.split("path", "/")[0].alias("folder"), "path", F.sha2("text", 256).alias("digest"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "digest"))), lambda r: F.concat(r["path"], F.lit("="), r["digest"])), "\n")
    return each.groupBy("folder").agg(F.sha2(joined, 256).alias("fingerprint"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (document, first word of a line), the first occurrence wins."""
    words = lines(_docs(spark, d), "doc_id").select("doc_id", "ln", F.split("line", " ")[0].alias("word"))
    return words.groupBy("doc_id", "word").agg(F.min("ln").alias("ln"))


def digest_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def union_hits(spark: SparkSession, d: str) -> DataFrame:
    """Names that start with a prefix, from three tables, as one list of hits."""
    part = table(spark, d, "part").where(F.col("p_name").startswith("a")).select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    customer = table(spark, d, "customer").where(F.col("c_name").contains("1")).select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    nation = table(spark, d, "nation").where(F.col("n_name") >= "M").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return part.unionByName(customer).unionByName(nation)


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of a corpus: reused, analyzed anew, deleted."""
    was = files(spark, d).where("doc_id % 10 <> 3").select("path", F.sha2("text", 256).alias("old"))
    now = files(spark, d).where("doc_id % 10 <> 7").select("path", F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("new"))
    state = F.when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "reused").otherwise("analyzed")
    return was.join(now, "path", "full_outer").select("path", state.alias("state"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.groupBy("lang").agg(F.count(F.lit(1)).alias("considered"), F.count("quality").alias("labelled"), F.bool_and(F.col("quality").isNotNull()).alias("complete"))


QUERIES = {q.__name__: q for q in (grep_content, grep_count, grep_files, grep_matches_only, grep_page, grep_cr, line_index, read_range, line_ending_style, minority_lines, convert_eol, trailing_ws, json_valid, binary_filter, byte_scalar_columns, common_run, fuzzy_match, glob_filter, search_topk_name, search_topk_size, keyset_page, list_directory, tree_listing, ignore_rules, fingerprint_docs, dedup_first, digest_counts, union_hits, snapshot_diff, coverage)}

ORACLE_SQL = {
    "grep_content": f"with {LINES_SQL}, x as (select *, coalesce(lag(line) over w, '') as before, coalesce(lead(line) over w, '') as after from l window w as (partition by doc_id order by ln)) select doc_id, cast(ln as int) as ln, cast(strlen(regexp_extract(line, '^(.*?)(?:the|der)', 1)) + 1 as int) as col, line as text, before, after from x where regexp_matches(line, '(?:the)|(?:der)')",
    "grep_count": rf"with {LINES_SQL} select doc_id, count(*) as n from l where regexp_matches(line, '(?:and)|(?:\bque\b)') group by doc_id",
    "grep_files": rf"with {FILES_SQL}, l as (select path, unnest(string_split(text, chr(10))) as line from f) select distinct path from l where regexp_matches(line, '\d{{3}}')",
    "grep_matches_only": rf"with {LINES_SQL} select doc_id, cast(ln as int) as ln, cast(strlen(regexp_extract(line, '^(.*?)(?:(?i:[a-z]+ing\b))', 1)) + 1 as int) as col, regexp_extract(line, '(?i:[a-z]+ing\b)', 0) as text from l where regexp_matches(line, '(?i:[a-z]+ing\b)')",
    "grep_page": f"with {LINES_SQL} select doc_id, cast(ln as int) as ln, cast(strlen(regexp_extract(line, '^(.*?)(?:de)', 1)) + 1 as int) as col, line as text from l where regexp_matches(line, 'de') order by doc_id, ln limit 25 offset 10",
    "grep_cr": f"with {MIXED_SQL}, l as (select doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) as line from m) select doc_id, count(*) as n from l where regexp_matches(line, '^[A-Z]') group by doc_id",
    "line_index": f"with {LINES_SQL} select doc_id, count(*) as n_lines, cast(max(strlen(line)) as bigint) as longest, cast(sum(strlen(line)) as bigint) as bytes from l group by doc_id",
    "read_range": f"with {LINES_SQL} select doc_id, coalesce(string_agg(line, chr(10) order by ln) filter (where ln between 2 and 4), '') as body, count(*) as total_lines from l group by doc_id",
    "line_ending_style": f"with {MIXED_SQL}, c as (select doc_id, len(text) - len(replace(text, chr(10), '')) as a, (len(text) - len(replace(text, chr(13) || chr(10), ''))) // 2 as b from m) select doc_id, cast(a - b as int) as lf, cast(b as int) as crlf, case when a - b > 0 and b > 0 then 'mixed' when b > 0 then 'crlf' when a > 0 then 'lf' else 'none' end as style from c",
    "minority_lines": f"with {MIXED_SQL}, s as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as ln, len(string_split(text, chr(10))) as n from m), k as (select doc_id, ln, suffix(raw, chr(13)) as crlf from s where ln < n), c as (select *, count(*) filter (where crlf) over (partition by doc_id) as nc, count(*) over (partition by doc_id) as na from k) select doc_id, cast(ln as int) as ln from c where nc > 0 and nc < na and crlf = (nc < na - nc)",
    "convert_eol": f"with {MIXED_SQL}, x as (select doc_id, replace(text, chr(13) || chr(10), chr(10)) as t from m) select doc_id, sha256(t) as lf_sha, sha256(replace(t, chr(10), chr(13) || chr(10))) as crlf_sha from x",
    "trailing_ws": f"with {MIXED_SQL}, l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as ln from m) select doc_id, cast(ln as int) as ln from l where regexp_matches(regexp_replace(line, '\\r$', ''), '[ \\t]$')",
    "json_valid": "select event_id, json_valid(case when event_id % 4 = 0 then props || '}' else props end) as valid from events",
    "binary_filter": "with x as (select doc_id, substr(case when doc_id % 8 = 4 then regexp_replace(text, '[aeiou]', chr(1), 'g') when doc_id % 8 = 0 then regexp_replace(text, 'z', chr(2), 'g') else text end, 1, 8192) as t from documents) select doc_id, len(regexp_extract_all(t, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]')) * 10 >= len(t) and len(t) > 0 as is_binary from x",
    "byte_scalar_columns": "select doc_id, cast(length(text) as bigint) as scalars, cast(strlen(text) as bigint) as bytes from documents",
    "common_run": f"with {LINES_SQL}, o as (select doc_id // 2 as pair, doc_id, ln, trim(line) as line from l where trim(line) <> ''), j as (select a.pair, a.ln as i, a.ln - b.ln as diagonal from o a join o b on a.pair = b.pair and a.line = b.line and a.doc_id % 2 = 0 and b.doc_id % 2 = 1), k as (select pair, diagonal, i - row_number() over (partition by pair, diagonal order by i) as island from j), r as (select pair, count(*) as run from k group by pair, diagonal, island) select pair, max(run) as run from r group by pair",
    "glob_filter": f"with {FILES_SQL} select path from f where regexp_matches(path, '^src[^/]*/(?:[^/]+/)*[^/]*\\.en$') and not (split_part(path, '/', 1) = 'src1' or regexp_matches(path, '^[^/]*7\\.en$') or regexp_matches(split_part(path, '/', 2), '^[^/]*7\\.en$'))",
    "search_topk_name": f"with {FILES_SQL} select path, split_part(path, '/', -1) as name from f order by name, path limit 20",
    "search_topk_size": f"with {FILES_SQL} select path, cast(strlen(text) as bigint) as size from f order by size desc, path desc limit 20",
    "keyset_page": "select o_orderpriority, o_orderkey from orders where (o_orderpriority, o_orderkey) > ('2-HIGH', 500) order by 1, 2 limit 50",
    "list_directory": f"with {FILES_SQL} select split_part(path, '/', 1) as folder, count(*) as n_files, cast(sum(strlen(text)) as bigint) as bytes from f group by 1",
    "tree_listing": f"with {FILES_SQL} select path, cast(1 as int) as depth, '  ' || split_part(path, '/', -1) as entry, replace(path, '/', chr(1)) as place from f union all select distinct split_part(path, '/', 1), cast(0 as int), split_part(path, '/', 1), split_part(path, '/', 1) from f",
    "ignore_rules": f"with {FILES_SQL} select path, case when starts_with(path, 'src0/') then true when regexp_matches(path, '^(?:[^/]+/)*1[^/]*\\.de$') then false when split_part(path, '/', 1) = 'src2' then true when regexp_matches(path, '\\.de$') then true else false end as ignored from f",
    "fingerprint_docs": f"with {FILES_SQL}, e as (select split_part(path, '/', 1) as folder, path, sha256(text) as digest from f) select folder, sha256(string_agg(path || '=' || digest, chr(10) order by path)) as fingerprint from e group by folder",
    "dedup_first": f"with {LINES_SQL} select doc_id, split_part(line, ' ', 1) as word, cast(min(ln) as int) as ln from l group by 1, 2",
    "digest_counts": "select user_id, event_type, count(*) as n from events group by all",
    "union_hits": "select 'part' as kind, p_partkey as id, p_name as name from part where starts_with(p_name, 'a') union all select 'customer', c_custkey, c_name from customer where contains(c_name, '1') union all select 'nation', n_nationkey, n_name from nation where n_name >= 'M'",
    "snapshot_diff": f"with {FILES_SQL}, a as (select path, sha256(text) as old from f where doc_id % 10 <> 3), b as (select path, sha256(case when doc_id % 4 = 0 then text || '!' else text end) as new from f where doc_id % 10 <> 7) select coalesce(a.path, b.path) as path, case when new is null then 'deleted' when old = new then 'reused' else 'analyzed' end as state from a full join b on a.path = b.path",
    "coverage": "select lang, count(*) as considered, count(quality) as labelled, bool_and(quality is not null) as complete from documents d left join labels l on d.doc_id = l.doc_id group by lang",
}
