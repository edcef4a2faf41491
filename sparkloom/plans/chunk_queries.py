"""Registered queries on files in chunks, regions of pages and folders of rules, each with its SQL for comparison where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import chunks as ch
from sparkloom.operators import detect as dt
from sparkloom.operators import admission, digests, generations, ignore, regions
from sparkloom.plans.text_queries import MIXED_SQL, _mixed
from sparkloom.sources.corpus import files, table
from sparkloom.sources.shared import shared_folder

#: An odd size, so that chunks end within characters and line endings.
CHUNK = 997


def chunked_endings(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks, their line endings made LF chunk by chunk: counts, and a digest of what the pieces make together."""
    made = ch.convert_endings(ch.cut_text(_mixed(spark, d), "doc_id", CHUNK), "doc_id")
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("no", "content"))), F.lit(b""), lambda a, p: F.concat(a, p["content"]))
    return made.groupBy("doc_id").agg(F.sum("lf").alias("lf"), F.sum("crlf").alias("crlf"), F.md5(whole).alias("digest"))


def chunked_utf8(spark: SparkSession, d: str) -> DataFrame:
    """Texts in chunks, every fourth with a byte that no character may have at its end: (doc_id, valid, bad_no)."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 4 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))).alias("text"))
    return ch.utf8_checks(ch.cut_text(docs, "doc_id", CHUNK), "doc_id")


def detect_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts written in five encodings, in chunks, and what is found: (doc_id, written, charset, confidence)."""
    docs = table(spark, d, "documents").where("text is not null")
    names = ["UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32", "ISO-8859-1"]
    latin = F.regexp_replace("text", r"[^\x00-\x7F\xA0-\xFF]", "?")
    coded = [F.encode("text", n) for n in names[:-1]] + [F.encode(latin, names[-1])]
    k = F.col("doc_id") % len(names)
    raw = F.coalesce(*[F.when(k == i, c) for i, c in enumerate(coded)])
    written = docs.select("doc_id", F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")).alias("written"), raw.alias("text"))
    return written.select("doc_id", "written").join(dt.detect(ch.cut_text(written, "doc_id", CHUNK), "doc_id"), "doc_id")


def page_segments(spark: SparkSession, d: str) -> DataFrame:
    """Pages from end to end, as markup, comments, scripts and styles."""
    return regions.segments(table(spark, d, "pages"), "page_id", "html")


def page_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Elements and embedded regions of pages, with the element around each."""
    return regions.scopes(table(spark, d, "pages"), "page_id", "html")


def nested_ignore(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as a tree with an ignore file at its root and one in each source's folder, made of the ids that it holds."""
    own = files(spark, d)
    top = spark.range(1).select(F.lit("").alias("scope"), F.lit("# all sources\n*.fr\nsrc3/\n!**/1?.fr  \n").alias("text"))
    folders = own.groupBy(F.split("path", "/")[0].alias("scope")).agg(F.min("doc_id").cast("string").alias("m"))
    each = folders.select("scope", F.concat("m", F.lit("*.en\n!"), "m", F.lit("0*\r\n/*[13].de\n"), "m", F.lit(".*/\n")).alias("text"))
    return ignore.ignored(own.select("path", F.lit(False).alias("is_dir")), top.union(each))


def folder_digests(spark: SparkSession, d: str) -> DataFrame:
    """A digest of each source's files: paths, sizes and contents in the order of paths."""
    own = files(spark, d).where("text is not null")
    record = digests.framed(F.col("path"), F.lit("file"), F.octet_length("text").cast("string"), F.unhex(F.sha2("text", 256)))
    return digests.tree_digest(own.select(F.split("path", "/")[0].alias("folder"), "path", record.alias("record")), "folder", "path", "record")


def task_admission(spark: SparkSession, d: str) -> DataFrame:
    """Events as queued tasks that lock their user and one of some resources."""
    events = table(spark, d, "events")
    lock = lambda letter, of: F.concat(F.lit(letter), of.cast("string"))
    tasks = events.select(F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 10).alias("starts"), F.array(lock("u", F.col("user_id")), lock("r", F.col("event_id") % 61)).alias("locks"))
    return admission.admit(tasks, events.where("user_id % 50 = 7").select(lock("u", F.col("user_id")).alias("lock")), 40)


def read_failures(spark: SparkSession, d: str) -> DataFrame:
    """Line items that ask for documents: how many are missing by return flag, and details of the first ones in 2,000 bytes."""
    asked = table(spark, d, "lineitem").select("l_returnflag", F.format_string("%012d/%d", "l_orderkey", "l_linenumber").alias("place"), F.col("l_partkey").alias("doc_id"))
    lost = asked.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    failed = lost.select("l_returnflag", "place", F.format_string("doc/%d", "doc_id").alias("path"), F.lit("NOT_FOUND").alias("code"))
    found = digests.collect_errors(failed, "l_returnflag", "place", ["path", "code"], 2000)
    return found.select("l_returnflag", "total", "omitted", F.array_join(F.transform("kept", lambda k: k["path"]), " ").alias("kept"))


def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    """An index of most documents, every fourth with another text, refreshed to all as they are: how many references each file has to others."""
    own = files(spark, d).select("path", "doc_id", "text")
    index = generations.Index(spark, shared_folder(spark, "index"), generations.words_and_titles, "words 1")
    index.refresh(own.where("doc_id % 10 <> 3").select("path", F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text")).alias("text")))
    last = index.refresh(own.select("path", "text"))
    return index.summary(last)


#: As page_segments' rules, for DuckDB.
_REGIONS = r"(?is)<!--.*?(?:-->|\z)|<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)"

QUERIES = {q.__name__: q for q in (chunked_endings, chunked_utf8, detect_chunks, page_segments, page_scopes, nested_ignore, folder_digests, task_admission, read_failures, index_refresh)}
ORACLE_SQL = {
    "chunked_endings": f"with {MIXED_SQL} select doc_id, length(text) - length(replace(text, chr(10), '')) - (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as lf, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as crlf, md5(replace(text, chr(13) || chr(10), chr(10))) as digest from m",
    "page_segments": f"""
with p as (select page_id, regexp_extract_all(html, '{_REGIONS}') as found, string_split_regex(html, '{_REGIONS}') as gaps from pages),
e as (select page_id, unnest(generate_series(1, len(gaps))) as i, gaps, found from p),
k as (select page_id, i, strlen(gaps[i]) as gap, coalesce(strlen(found[i]), 0) as size, found[i] as token from e),
o as (select *, sum(gap + size) over (partition by page_id order by i) as fin from k),
s as (
  select page_id, fin - size - gap as start, fin - size as stop, 'host' as kind, true as closed from o
  union all
  select page_id, fin - size, fin, case when starts_with(token, '<!--') then 'comment' when lower(token) like '<script%' then 'script' else 'style' end,
    case when starts_with(token, '<!--') then ends_with(token, '-->') and strlen(token) > 6 else regexp_matches(lower(token), '</(script|style)\\s*>$') end
  from o where token is not null)
select page_id, start::int as start, stop::int as "end", kind, closed from s where start < stop""",
    "chunked_utf8": f"select doc_id, doc_id % 4 <> 0 as valid, case when doc_id % 4 = 0 then strlen(text) // {CHUNK} end as bad_no from documents",
    "nested_ignore": r"""
with f as (select source || '/' || doc_id || '.' || lang as path, source, doc_id || '.' || lang as base, min(doc_id) over (partition by source)::varchar as m from documents)
select path, source = 'src3' or case when regexp_matches(base, '^.*[13]\.de$') then true when starts_with(base, m || '0') then false
  when starts_with(base, m) and ends_with(base, '.en') then true when regexp_matches(base, '^1.\.fr$') then false when ends_with(base, '.fr') then true else false end as ignored
from f""",
    # Two levels are enough for a million files a folder.
    "folder_digests": """
with f as (select source as folder, source || '/' || doc_id || '.' || lang as path, text from documents where text is not null),
frame as (select *, row_number() over (partition by folder order by path) - 1 as k, count(*) over (partition by folder) as n,
  unhex(lpad(printf('%X', strlen(path)), 16, '0')) || encode(path) || unhex('0000000000000004') || encode('file') || unhex(lpad(printf('%X', length(strlen(text)::varchar)), 16, '0')) || encode(strlen(text)::varchar) || unhex('0000000000000020') || unhex(sha256(text)) as record from f),
one as (select folder, n, k // 1024 as k, sha256(unhex('000000000000000131' || string_agg(sha256(record), '' order by k))) as digest from frame group by all),
two as (select folder, n, case when n <= 1024 then min(digest) else sha256(unhex('000000000000000132' || string_agg(digest, '' order by k))) end as digest from one group by folder, n)
select folder, n, sha256(unhex('0000000000000004') || encode('root') || unhex(lpad(printf('%X', length(n::varchar)), 16, '0')) || encode(n::varchar) || unhex('0000000000000040') || encode(digest)) as digest from two""",
    "index_refresh": r"""
with f as (select source || '/' || doc_id || '.' || lang as path, regexp_extract_all(coalesce(text, ''), '\p{L}+') as words from documents),
d as (select path as tgt, words[1] as name from f where len(words) > 0), r as (select distinct path as src, unnest(words[2:]) as name from f)
select src, count(*) as n, min(name) as first, max(tgt) as last from r join d using (name) where length(name) >= 7 and src <> tgt group by src""",
}
