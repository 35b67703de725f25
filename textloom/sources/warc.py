"""WARC files as documents."""

from __future__ import annotations

import gzip
import html
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RECORDS = "url string, id string, date string, kind string, content_type string, body binary"
_ARROW = pa.schema([("url", pa.string()), ("id", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("content_type", pa.string()), ("body", pa.binary())])


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, gzipped by record, as a whole or not at all; header names in lower case."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers.get("content-length", 0)))


def payload(headers: dict[str, str], block: bytes) -> tuple[str, bytes]:
    """(content type, body) of a record: what follows the HTTP headers of a response, the block of a resource."""
    if not block.startswith(b"HTTP/"):
        return headers.get("content-type", ""), block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if http.get("content-encoding", "").lower() == "gzip":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            body = b""
    return http.get("content-type", ""), body


def decode(body: bytes, content_type: str) -> str | None:
    """Text by the declared charset, that of the page's head, or UTF-8; null if none fits."""
    found = re.search(r"charset=[\"']?([\w-]+)", content_type, re.IGNORECASE) or re.search(rb"<meta[^>]+charset=[\"']?([\w-]+)", body[:2048], re.IGNORECASE)
    name = found[1] if found else "utf-8"
    for charset in (name.decode("ascii") if isinstance(name, bytes) else name, "utf-8"):
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return None


def read_warc(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(url, id, date, kind, content_type, body) of responses and resources that have an address and a payload digest; the digest is the id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, size, made = [], 0, None
                for headers, block in records(data):
                    kind = headers.get("warc-type")
                    if kind == "warcinfo":
                        made = headers.get("warc-date")
                    url, digest = headers.get("warc-target-uri"), headers.get("warc-payload-digest")
                    if kind not in ("response", "resource") or not url or not digest:
                        continue
                    content_type, body = payload(headers, block)
                    rows.append((url.strip("<>"), digest.rpartition(":")[2].lower(), headers.get("warc-date") or made, kind, content_type, body))
                    size += len(body)
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return files.mapInArrow(run, _RECORDS)


def normalize_url(url: Column) -> Column:
    """Address without quotes and brackets around it, scheme, www and its number; host in lower case."""
    bare = F.regexp_replace(url, r"^[\s\"'<>()\[\]]+|[\s\"'<>()\[\]]+$", "")
    bare = F.regexp_replace(bare, r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    bare = F.regexp_replace(bare, r"^(?i:www\d*\.)", "")
    host = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))


_DROP = re.compile(r"(?is)<(script|style|noscript|template|head)\b.*?</\1\s*>|<!--.*?-->")
_ASIDE = re.compile(r"(?is)<(nav|header|footer|aside|form)\b.*?</\1\s*>")
_BLOCK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote|pre|hr)\b[^>]*>")


def linearize(page: str, main_only: bool = True) -> str:
    """A page's text, block elements on lines of their own; without navigation and its like if ``main_only``."""
    body = _DROP.sub(" ", page)
    if main_only:
        body = _ASIDE.sub(" ", body)
    body = re.sub(r"<[^>]*>", "", _BLOCK.sub("\n", re.sub(r"\s+", " ", body)))
    lines = (" ".join(x.split()) for x in html.unescape(body).split("\n"))
    return "\n".join(x for x in lines if x)


LINEARIZERS = {"main": lambda page: linearize(page, True), "all": lambda page: linearize(page, False)}


def linearized(page: Column, how: str = "main") -> Column:
    make = LINEARIZERS[how]

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else make(p) for p in pages.to_pylist()], pa.string())

    run.__annotations__ = {"pages": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(page)


def warc_documents(recs: DataFrame, how: str = "main", source: str = "warc", pre_taggers: list[str] | None = None, post_taggers: list[str] | None = None, skip_untagged: bool = False) -> DataFrame:
    """Documents of read_warc(): text from the page, its address normalised, the page itself in html.

    ``pre_taggers`` see the page, ``post_taggers`` the text; with ``skip_untagged`` documents of which no pre-tagger finds anything go.
    """
    from ..operators.registry import attributes

    def decode_all(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([None if b is None else decode(b, k or "") for b, k in zip(bodies.to_pylist(), kinds.to_pylist())], pa.string())

    decode_all.__annotations__ = {"bodies": pa.Array, "kinds": pa.Array, "return": pa.Array}
    docs = recs.withColumn("html", F.arrow_udf(decode_all, "string").asNondeterministic()("body", "content_type")).where("html IS NOT NULL").drop("body")
    if pre_taggers:
        docs = docs.withColumn("pre", attributes(F.col("html"), F.col("id"), pre_taggers, "pre", {"html": F.col("html"), "url": F.col("url")}))
        if skip_untagged:
            docs = docs.where(F.exists(F.map_values("pre"), lambda s: F.size(s) > 0))
    docs = docs.withColumn("text", linearized(F.col("html"), how)).withColumn("url", normalize_url(F.col("url"))).withColumn("source", F.lit(source))
    if post_taggers:
        docs = docs.withColumn("post", attributes(F.col("text"), F.col("id"), post_taggers, "post", {"url": F.col("url")}))
    return docs.where("text <> ''")
