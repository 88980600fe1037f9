"""Operator 5, WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import gzip
import html as html_names
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import small_batches, table

HEADERS = "map<string,string>"
#: A tag, with quoted values that may hold its end; one whose quotes do not close ends at the first >.
TAG = r"""<[/!?A-Za-z](?:[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+|[^>]*+)>"""
CRLF = "\r\n"
#: Bytes of a .warc.gz file after which a task begins another one.
PART_BYTES = 1 << 28


def _uuid(*parts: Column) -> Column:
    """A record id that depends on its parts alone, so that a repeated task writes the same record."""
    h = F.md5(F.concat_ws("\u0000", *parts).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def _digest(body: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(body.cast("binary")))


def responses(pages: DataFrame, date: str | Column = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as WARC response records: page_id, headers, http headers, payload.

    date is the time of all, or a column of pages with that of each. Null url or html is empty; a null page_id stays null. Repeated
    pages are records each, with one id. An empty table gives none; extra columns, of whatever name, stay out.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF))
    headers = {
        "WARC-Type": F.lit("response"),
        "WARC-Record-ID": _uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), html),
        "WARC-Date": date if isinstance(date, Column) else F.lit(date),
        "WARC-Target-URI": F.coalesce("url", F.lit("")),
        "WARC-Payload-Digest": _digest(html),
        "WARC-Block-Digest": _digest(F.concat(http, F.lit(CRLF), html)),
        "Content-Type": F.lit("application/http; msgtype=response"),
    }
    pairs = [x for k, v in headers.items() for x in (F.lit(k), v)]
    return pages.select("page_id", F.create_map(*pairs).alias("headers"), http.alias("http"), html.alias("payload"))


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html_names.unescape, na_action="ignore")


def plain_text(html: Column) -> Column:
    """Comments, scripts and styles go, other tags become a line break, named and numeric entities characters; blank runs collapse.

    A < that begins no tag is text. A no-break space is space. Null stays null and empty empty; a page is worked on as a whole.
    """
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?is)<script\b.*?</script\s*>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b.*?</style\s*>", " ")
    text = _unescaped(F.regexp_replace(text, TAG, "\n"))
    text = F.regexp_replace(text, "[ \\t\\r\u00a0]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def derive(records: DataFrame) -> DataFrame:
    """Two records of each response: metadata and conversion, as page_id, kind, headers, block.

    Both carry WARC-Refers-To with the response's id and its target and date. The metadata block lists the source's HTTP
    headers, payload digest and link count as `name: value` lines; the conversion block is the plain text. Each record
    has its own id and block digest. Records of other types derive nothing; no field of a response may be missing but may be
    empty. Repeated responses derive equal records each; an empty table gives none; extra columns stay out.
    """
    source = records.filter(F.col("headers")["WARC-Type"] == "response")
    h = F.col("headers")
    links = F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\s[^>]*href"), F.lit(0)))
    fields = [("payload-digest", h["WARC-Payload-Digest"]), ("payload-bytes", F.octet_length("payload").cast("string")), ("links", links.cast("string"))]
    about = F.concat(F.regexp_replace(F.col("http"), r"(?m)^(?=[A-Za-z0-9-]+:)", "http-"), *[x for k, v in fields for x in (F.lit(f"{k}: "), v, F.lit(CRLF))])
    shape = "array<struct<kind:string,type:string,block:string>>"
    both = F.array(F.struct(F.lit("metadata"), F.lit("application/warc-fields"), about), F.struct(F.lit("conversion"), F.lit("text/plain; charset=utf-8"), plain_text(F.col("payload"))))
    rows = source.select("page_id", h.alias("source"), F.explode(both.cast(shape)).alias("r")).select("page_id", "source", "r.*")
    s = F.col("source")
    new = {
        "WARC-Type": F.col("kind"),
        "WARC-Record-ID": _uuid(F.col("kind"), s["WARC-Record-ID"]),
        "WARC-Date": s["WARC-Date"],
        "WARC-Target-URI": s["WARC-Target-URI"],
        "WARC-Refers-To": s["WARC-Record-ID"],
        "WARC-Refers-To-Target-URI": s["WARC-Target-URI"],
        "WARC-Refers-To-Date": s["WARC-Date"],
        "WARC-Source-Payload-Digest": s["WARC-Payload-Digest"],
        "WARC-Block-Digest": _digest(F.col("block")),
        "Content-Type": F.col("type"),
    }
    return rows.select("page_id", "kind", F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]).alias("headers"), "block")


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record, as a gzip member of its own."""
    lines = "".join(f"{k}: {v}{CRLF}" for k, v in headers.items() if k != "Content-Length")
    return gzip.compress(f"WARC/1.1{CRLF}{lines}Content-Length: {len(block)}{CRLF}{CRLF}".encode() + block + f"{CRLF}{CRLF}".encode(), 6, mtime=0)


def write_warc(records: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write records (headers, block) as .warc.gz files of a folder, and give (path, records, bytes) of each file.

    A record is a gzip member of its own, so readers may begin at any. A task writes its files beside their names and renames each
    when it is whole; its attempt is part of the name, so one that is repeated disturbs no other, and the list that Spark gives
    back has the files of the attempts that count, each once. The list is written to the folder as well, under files. Null
    blocks are empty; no records give no file; extra columns stay out. A record is held as a whole, a file never is.
    """
    small_batches(records.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        task, number, out, path, n, size, done = TaskContext.get(), 0, None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                fs.move(path + ".part", path)
                done.append((f"{folder}/{path.rpartition('/')[2]}", n, size))
                out = None

        for batch in batches:
            for headers, block in zip(batch["headers"].to_pylist(), batch["block"].to_pylist(), strict=True):
                if out is None:
                    path, n, size = f"{inner}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}.warc.gz", 0, 0
                    out, number = fs.open_output_stream(path + ".part"), number + 1
                member = serialise(dict(headers), (block or "").encode("utf-8", "surrogatepass"))
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= part_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    made = records.select("headers", "block").mapInArrow(run, "path string, records long, bytes long")
    made.write.mode("overwrite").parquet(f"{folder}/files")
    return records.sparkSession.read.schema("path string, records long, bytes long").parquet(f"{folder}/files")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a .warc.gz file, whatever its members hold, from its bytes in chunks; one record is held at a time.

    Header names come as they are written; of one that is repeated the last counts. A file that breaks off ends with its last
    whole record.
    """
    data, member = bytearray(), zlib.decompressobj(31)

    def more() -> bool:
        nonlocal member
        for chunk in chunks:
            while chunk:
                data.extend(member.decompress(chunk))
                chunk = member.unused_data
                if member.eof:
                    member = zlib.decompressobj(31)
            return True
        return False

    while True:
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        headers = dict(re.findall(r"^([^:\r\n]+):[ \t]*(.*?)\r?$", data[:end].decode("utf-8", "replace"), re.M))
        n = int({k.lower(): v for k, v in headers.items()}["content-length"])
        while len(data) < end + 4 + n:
            if not more():
                return
        yield headers, bytes(data[end + 4 : end + 4 + n])
        del data[: end + 4 + n]
        while data[:2] == b"\r\n" or len(data) < 2:
            if len(data) >= 2:
                del data[:2]
            elif not more():
                break


def read_warc(files: DataFrame) -> DataFrame:
    """headers and block of the records of .warc.gz files (path), as write_warc() lists them; a file is read by one task, in pieces."""
    width = files.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                fs, inner = pyarrow.fs.FileSystem.from_uri(path)
                held, size = [], 0
                with fs.open_input_stream(inner, compression=None) as stream:
                    for record in parse(iter(lambda: stream.read(1 << 20), b"")):
                        held.append(record)
                        size += len(record[1])
                        if size > 1 << 23:
                            yield _records(held)
                            held, size = [], 0
                if held:
                    yield _records(held)

    return files.select("path").repartition(width, "path").mapInArrow(run, f"headers {HEADERS}, block string")


def _records(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    headers = pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([headers, pa.array([b.decode("utf-8", "replace") for _, b in found], pa.string())], ["headers", "block"])


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("headers")
    return derive(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"))).select(
        "page_id", "kind", h["WARC-Record-ID"].alias("record_id"), h["WARC-Refers-To"].alias("refers_to"), h["WARC-Target-URI"].alias("target_uri"),
        h["WARC-Source-Payload-Digest"].alias("payload_digest"), h["WARC-Block-Digest"].alias("block_digest"), F.octet_length("block").cast("long").alias("n_bytes"),
    )


_ID = "'urn:uuid:' || substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"
ORACLE = rf"""
WITH src AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), resp AS (
  SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS http,
         md5('response' || chr(0) || coalesce(page_id::VARCHAR, '') || chr(0) || url || chr(0) || html) AS rh, 'sha1:' || sha1(html) AS pd FROM src
), named AS (
  SELECT *, {_ID.format("rh")} AS rid,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<[/!?A-Za-z]([^>"'']*("[^"]*"[^>"'']*|''[^'']*''[^>"'']*)*|[^>]*)>', chr(10), 'g') AS t0
  FROM resp
), txt AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t0, '&nbsp;?', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g'), '[ \t\r\x{{A0}}]+', ' ', 'g') AS t1 FROM named
), both_kinds AS (
  SELECT page_id, url, rid, pd, 'conversion' AS kind, trim(regexp_replace(t1, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS block FROM txt
  UNION ALL
  SELECT page_id, url, rid, pd, 'metadata', 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'http-Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'http-Content-Length: ' || strlen(html) || chr(13) || chr(10)
    || 'payload-digest: ' || pd || chr(13) || chr(10) || 'payload-bytes: ' || strlen(html) || chr(13) || chr(10) || 'links: ' || len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) || chr(13) || chr(10) FROM txt
)
SELECT page_id, kind, {_ID.format("md5(kind || chr(0) || rid)")} AS record_id, rid AS refers_to, url AS target_uri, pd AS payload_digest, 'sha1:' || sha1(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS n_bytes
FROM both_kinds
"""
