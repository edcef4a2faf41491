"""WARC derivatives: a metadata and a plain-text conversion record for each response record.

A response's HTML gives the plain text (a conversion record) and a few fields with its links (a metadata record).
Both refer to the response by WARC-Refers-To, keep its target URI, date and payload digest, carry the names of
its HTTP headers on, and name each other by WARC-Concurrent-To; their own ids are functions of the response's id,
so a task that runs again makes the same records.  Bodies are taken as they were meant: chunked transfer and gzip or deflate
codings are undone, the character set is that of the header, else of a byte order mark or a meta element, else UTF-8, and a
base element counts for links.  A coding that is unknown, damaged or inflates beyond INFLATED bytes leaves the body as it is.

Records are rows; write_files() and read_files() turn them into gzip WARC files (a member for each record) and
back.  Rows are handled one by one, so memory follows the longest page, not the size of a partition.

Nulls and edge cases: null html is an empty payload, whose text is empty; a null url gives records without a
target URI; repeated rows are records of their own, with ids of their own.  An empty table gives no records.  Records of other
types have no derivatives.  Line breaks in
header values become spaces.  Comments, scripts and styles that never close reach to the end of the page, and no
title, language or link within them counts; a `<` that begins no tag is text.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import html
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import files
from sparkloom.llm.common import fresh

DATE = "2024-01-01T00:00:00Z"
#: The most bytes that a coded body may grow to, and the most repeated pages that are broadcast.
INFLATED, SMALL = 1 << 28, 1 << 20
CRLF = b"\r\n"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.I)
_BASE = re.compile(r"<base\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s<>\"']+))", re.I)
_META = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
#: Elements that begin and end lines.  Fixed values.
_BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th tr ul".split())
_TAG = re.compile(r"<(?:/?([A-Za-z]\w*)|[A-Za-z/!?])[^<>]*>")
#: Links whose resolution is plain: an absolute path without dots on a plain address.
_ORIGIN, _PLAIN_PATH = re.compile(r"https?://[^/?#\s\\]+(?=[/?#]|\Z)"), re.compile(r"/(?!/)[\w~%,=+&/-]*")
_BLANK = re.compile(r"[^\S\n]+")

RECORD = "key bigint, warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers map<string,string>, block binary"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_TYPES = [pa.int64(), *[pa.string()] * 6, pa.map_(pa.string(), pa.string()), pa.binary()]


_PAIRS = [a + b for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for b in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def digest(data: bytes) -> str:
    """SHA-1 in base 32, ten bits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def record_id(*parts: object) -> str:
    name = "\x1f".join("" if p is None else f"={p}" for p in parts)
    h = hashlib.sha256(name.encode("utf-8", "surrogatepass")).hexdigest()
    # The bits of a name-based UUID.
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-{int(h[16], 16) & 3 | 8:x}{h[17:20]}-{h[20:32]}>"


def uncover(page: str) -> tuple[str, str | None]:
    """The page without its hidden parts, and its title: the first one that no other hidden part contains."""
    titles = []

    def hide(part: re.Match) -> str:
        if not titles and (part[1] or "").lower() == "title":
            titles.append(_BLANK.sub(" ", html.unescape(_TITLE.match(part[0])[1]).replace("\n", " ")).strip())
        return ""

    return _HIDDEN.sub(hide, page), titles[0] if titles else None


def plain_text(seen: str) -> str:
    """The text of a whole uncovered page: a line for each block element, entities decoded, blanks collapsed."""
    parts = _TAG.split(seen)
    parts[1::2] = ["\n" if name and name.lower() in _BLOCKS else "" for name in parts[1::2]]
    shown = "".join(parts)
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def links(seen: str, base: str | None) -> list[str]:
    """Targets of an uncovered page's links, resolved against its address, in order, each once."""
    out = dict.fromkeys(html.unescape(a or b or c).strip() for a, b, c in _LINK.findall(seen))
    found = []
    if declared := _BASE.search(seen):
        with contextlib.suppress(ValueError):
            base = urljoin(base or "", html.unescape(declared[1] or declared[2] or declared[3] or "").strip())
    origin = _ORIGIN.match(base or "")
    for target in out:
        if origin and _PLAIN_PATH.fullmatch(target) and "//" not in target:
            found.append(origin[0] + target)
            continue
        try:
            found.append(urljoin(base or "", target))
        except ValueError:  # no valid address
            found.append(target)
    return list(dict.fromkeys(found))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _batches(rows: Iterator[tuple], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1]) + 500
        if size >= most:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def responses(pages: DataFrame, date: str = DATE, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records of crawled pages: an HTTP message each, with block and payload digests."""

    copy = fresh(pages, "copy")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.col(page).alias("page"))
    own = ["key", "url", F.xxhash64("page").alias("hash")]
    repeated = rows.select(*own).groupBy("key", "url", "hash").count().where("count > 1").select(F.coalesce("key", F.lit(0)).alias("k"), "hash").distinct()
    if repeated.isEmpty():
        numbered = rows.withColumn(copy, F.lit(1))
    else:
        few = F.broadcast(repeated) if repeated.count() <= SMALL else repeated
        met = (F.coalesce(rows["key"], F.lit(0)) == few["k"]) & (F.xxhash64(rows["page"]) == few["hash"])
        again = rows.join(few, met, "left_semi").groupBy("key", "url", "page").count()
        numbered = rows.join(few, met, "left_anti").withColumn(copy, F.lit(1)).unionByName(again.select("key", "url", "page", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias(copy)))

    def build(rows: Iterator[tuple]) -> Iterator[tuple]:
        for k, address, text, number in rows:
            payload = (text or "").encode("utf-8", "surrogatepass")
            block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}".encode(), b"", payload])
            paid = digest(payload)
            headers = {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": paid}
            named = record_id(k, address, paid) if number == 1 else record_id(k, address, paid, number)
            yield k, "response", named, None, address, date, "application/http; msgtype=response", list(headers.items()), block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(build(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)))

    return numbered.mapInArrow(run, RECORD)


def split_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields and body of an HTTP message; all is body if there is no header."""
    head, blank, body = block.partition(CRLF + CRLF)
    if not blank or not head.startswith(b"HTTP/"):
        return [], block
    fields = [line.decode("latin-1").partition(":") for line in head.split(CRLF)[1:]]
    return [(name.strip(), value.strip()) for name, colon, value in fields if colon], body


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked transfer; an unfinished one gives what there is, no chunked one itself."""
    out, at = [], 0
    while (line := body.find(CRLF, at)) >= 0:
        size = re.fullmatch(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;.*)?", body[at:line], re.S)
        if size is None:
            return b"".join(out) if out else body
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """The body without a gzip or deflate coding; itself if it is none or damaged from the start."""
    for wbits in {"gzip": [31], "x-gzip": [31], "deflate": [15, -15]}.get(coding, []):
        unpack = zlib.decompressobj(wbits)
        with contextlib.suppress(zlib.error):
            made = unpack.decompress(body, INFLATED)
            if made and not unpack.unconsumed_tail:
                return made
    return body


def page_of(fields: list[tuple[str, str]], body: bytes) -> str:
    """The text of an HTTP body under its header fields."""
    named = {}
    for name, value in fields:
        named[name.lower()] = f"{named[name.lower()]}, {value}" if name.lower() in named else value
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = dechunked(body)
    for coding in reversed(named.get("content-encoding", "").lower().split(",")):
        body = inflated(body, coding.strip())
    declared = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", named.get("content-type", ""), re.I)
    marks = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
    mark = next((m for m in marks if body.startswith(m[0])), None)
    meta = _META.search(body, 0, 4096)
    charset = declared[1] if declared else mark[1] if mark else meta[1].decode("ascii") if meta else "utf-8"
    if mark and mark[1].startswith(charset.lower().replace("_", "-")):
        body, charset = body[len(mark[0]) :], mark[1]
    try:
        return body.decode(charset, "replace")
    except (LookupError, ValueError):  # not a character set
        return body.decode("utf-8", "replace")


def derivatives(row: tuple) -> list[tuple]:
    """The metadata and the conversion record of one record; none unless it is a response."""
    key, kind, own, _, target, date, _, headers, block = row
    if kind != "response":
        return []
    fields, body = split_http(block or b"")
    page = page_of(fields, body)
    source = dict(headers or [])
    metadata, conversion = record_id("metadata", own), record_id("conversion", own)
    seen, title = uncover(page)
    text = plain_text(seen).encode("utf-8", "surrogatepass")
    language = _LANGUAGE.search(seen)
    described = [("title", title) if title is not None else None, ("language", language[1]) if language else None]
    described += [(f"http-{name.lower()}", value) for name, value in fields]
    paid = digest(text)
    described += [("text-length", str(len(text))), ("text-digest", paid)]
    described += [("outlink", link) for link in links(seen, target)]
    lines = [f"{name}: {re.sub(r'[\r\n]+', ' ', value)}" for name, value in filter(None, described)]
    about = "\r\n".join([*lines, ""]).encode("utf-8", "surrogatepass")
    refers = [(name, value) for name, value in (("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)) if value is not None]
    kept = [(f"WARC-Source-{name[5:]}", value) for name, value in source.items() if name in ("WARC-Block-Digest", "WARC-Payload-Digest")]

    def made(kind: str, own_id: str, other: str, content: str, data: bytes, paid: str) -> tuple:
        return key, kind, own_id, own, target, date, content, [("WARC-Block-Digest", paid), *kept, *refers, ("WARC-Concurrent-To", other)], data

    return [made("metadata", metadata, conversion, "application/warc-fields", about, digest(about)), made("conversion", conversion, metadata, "text/plain; charset=utf-8", text, paid)]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(len(_NAMES))), strict=True)


def derive(records: DataFrame) -> DataFrame:
    """The derivative records of all response records in records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(made for batch in batches for row in _rows(batch) for made in derivatives(row))

    return records.select(*_NAMES).mapInArrow(run, RECORD)


def to_bytes(row: tuple) -> bytes:
    _, kind, own, refers, target, date, content, headers, block = row
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Target-URI", target), ("WARC-Date", date), *(headers or []), ("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {re.sub(r'[\r\n]+', ' ', value)}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + CRLF + block + CRLF * 2


def write_files(records: DataFrame, folder: str, made_of=lambda row: [row], level: int = 6) -> DataFrame:
    """Writes the records that made_of gives for each record, a gzip WARC file for each task: (path, key, record_id) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        with files.writing(path) as out:
            for batch in batches:
                own = []
                for row in _rows(batch):
                    for record in made_of(row):
                        out.write(gzip.compress(to_bytes(record), level, mtime=0))
                        own.append((record[0], record[2]))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array([k for k, _ in own], pa.int64()), pa.array([i for _, i in own], pa.string())], ["path", "key", "record_id"])

    return records.select(*_NAMES).mapInArrow(run, "path string, key bigint, record_id string")


_OWN_FIELDS = {"warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "content-length"}


def parse(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """Records of a WARC stream, in the form of rows; key is null."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            head.append(line)
        fields = [(name.strip(), value.strip()) for name, _, value in (x.partition(":") for x in b"".join(head).decode("utf-8", "replace").split("\n") if x)]
        own = {name.lower(): value for name, value in fields}
        block = stream.read(int(own.get("content-length", 0)))
        named = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type")
        rest = {n: v for n, v in fields if n.lower() not in _OWN_FIELDS}
        yield None, *(own.get(n) for n in named), list(rest.items()), block


def read_files(spark: SparkSession, folder: str, pattern: str = "*.warc.gz") -> DataFrame:
    """Records of all WARC files in folder; a file is read as a stream, record by record."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.reading(path) as source, io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 17) as stream:
                    yield from _batches(parse(stream))

    return found.mapInArrow(run, RECORD)
