"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record that refer to it.

`responses` wraps pages as response records; `derive` reads response records and makes the two derivatives, keeping the
identifier they refer to, the target, the date, the source's headers and its digests. `serialize` gives the bytes of
records and `parse` reads them back; `read` takes the records of .warc and .warc.gz files, `write` makes .warc.gz files
of a member per record. Identifiers are name-based (SHA-1 of target, payload and type), so a rerun after
lost executors gives the same records; equal pages have equal identifiers. Every page is handled alone: no shuffle.

Plain text: comments and the contents of script, style, noscript and template go; tags that break lines become line
feeds, others nothing; character references are resolved; white space is collapsed and empty lines go. A null page
has an empty payload, a null address an empty target. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches

DATE = "1970-01-01T00:00:00Z"
KINDS = ("response", "metadata", "conversion")
# Elements that break lines, and those whose contents are no text.
_BREAKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_TAG = re.compile(r"<(!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_HREF = re.compile(r"""\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def convert(page: str) -> tuple[str, str, list[str]]:
    """(plain text, title, addresses of links) of an HTML page, in one pass over it."""
    out: list[str] = []
    title: list[str] | None = None
    links: list[str] = []
    at, in_title, low, gone = 0, False, page.lower() if page.isascii() else None, set()
    if low is None:
        low = re.sub(r"[A-Z]+", lambda m: m[0].lower(), page)  # keeps places
    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            out.append(piece)
            if in_title:
                title.append(piece)
        if not m:
            break
        if m[1] == "!--":
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", m.end())
        if end < 0:
            break
        at = end + 1
        if m[1][0] in "!?":
            continue
        name = _NAME.match(page, m.end() - 1)[0].lower()
        closing = m[1][0] == "/"
        if name in _BREAKS:
            out.append("\n")
        if name == "title":
            if not closing and title is None:
                title, in_title = [], True
            elif closing:
                in_title = False
        elif name == "a" and not closing and (h := _HREF.search(page, m.end(), end)):
            links.append(html.unescape(next(x for x in h.groups() if x is not None)))
        elif name in _HIDDEN and not closing and name not in gone:
            close = low.find(f"</{name}", at)
            if close < 0:
                gone.add(name)
            else:
                at = close
    tidy = lambda s: " ".join(html.unescape(s).split())
    text = "".join(out)
    lines = [x for x in (tidy(line) for line in text.split("\n")) if x]
    return "\n".join(lines), tidy("".join(title or [])), links


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, target: str, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {target} {payload}')}>"


def _one_line(s: str) -> str:
    return re.sub(r"[\r\n]+", " ", s)


def response(url: str | None, page: str | None, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of the response record of a page."""
    body = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    payload, target = digest(body), _one_line(url or "")
    return [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", target, payload)), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ], block


def derive_one(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response record."""
    h = dict(headers)
    head, _, body = block.partition(b"\r\n\r\n")
    source, target, payload = h["WARC-Record-ID"], h.get("WARC-Target-URI", ""), h.get("WARC-Payload-Digest") or digest(body)
    text, title, links = convert(body.decode("utf-8", "replace"))
    ids = [record_id(k, target, payload) for k in KINDS[1:]]
    http = [x for x in head.decode("latin-1").split("\r\n")[1:] if x]
    fields = [("source-record-id", source), ("source-payload-digest", payload), ("source-block-digest", h.get("WARC-Block-Digest", "")), *(("source-header", x) for x in http)]
    fields += [("title", title), ("text-record-id", ids[1]), *(("outlink", _one_line(x)) for x in links)]
    plain = text.encode("utf-8", "replace")
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")
    out = []
    for kind, rid, data, mime in (("metadata", ids[0], meta, "application/warc-fields"), ("conversion", ids[1], plain, "text/plain; charset=utf-8")):
        out.append(([
            ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", h.get("WARC-Date", DATE)),
            ("WARC-Date", h.get("WARC-Date", DATE)), ("WARC-Target-URI", target), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(data)),
            ("Content-Type", mime), ("Content-Length", str(len(data))),
        ], data))
    return out


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The records of the bytes of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in lines[1:]]
        n = int(dict(headers)["Content-Length"])
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def inflate(data: bytes) -> Iterator[bytes]:
    """The members of gzip data, one at a time; data that is not gzip is one member."""
    if data[:2] != b"\x1f\x8b":
        if data:
            yield data
        return
    while data:
        member = zlib.decompressobj(wbits=31)
        out = member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("the last gzip member is cut off")
        yield out
        data = member.unused_data.lstrip(b"\0")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, number (from 0), kind and bytes of every record of the WARC files at path, compressed or not. Spark reads the
    files, from any store, each as one row: files up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = 0
                for member in inflate(content.as_py()):
                    for headers, block in parse(member):
                        kind = dict(headers).get("WARC-Type", "")
                        yield pa.RecordBatch.from_pydict({"file": [name], "number": pa.array([number], pa.int64()), "kind": [kind], "record": pa.array([serialize(headers, block)], pa.binary())})
                        number += 1

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, number bigint, kind string, record binary")


def write(records: DataFrame, path: str) -> int:
    """Write the column `record` as part files of gzip members under path (a URI of a file system that pyarrow opens, shared by
    all executors); the number of records written. A task that runs again replaces its own file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        part, n = TaskContext.get().partitionId(), 0
        held = f"{root}/.part-{part:05d}-{uuid.uuid4().hex}"
        with system.open_output_stream(held, compression=None) as out:
            for batch in batches:
                for x in batch.column(0):
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(member.compress(x.as_py()) + member.flush())
                    n += 1
        system.move(held, f"{root}/part-{part:05d}.warc.gz")
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return records.select("record").where("record is not null").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and the bytes of each page's response record."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = [serialize(*response(u.as_py(), p.as_py(), date)) for u, p in zip(part.column(1), part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, record binary")


def derive(records: DataFrame) -> DataFrame:
    """page_id, kind and bytes of every record: each response as it was, then its two derivatives."""
    kind = records.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, kinds, data = [], [], []
                for i, r in zip(part.column(0).to_pylist(), part.column(1)):
                    raw = r.as_py()
                    headers, block = next(parse(raw))
                    for k, x in zip(KINDS, (raw, *(serialize(*d) for d in derive_one(headers, block)))):
                        ids.append(i)
                        kinds.append(k)
                        data.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(kinds), pa.array(data, pa.binary())], names=["page_id", "kind", "record"])

    return records.mapInArrow(run, f"page_id {kind}, kind string, record binary")


def derive_pages(pages: DataFrame, date: str = DATE) -> DataFrame:
    """`derive` of the `responses` of pages, in one pass: each response is derived from as it is made."""
    bounded_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data = []
                for u, p in zip(part.column(1), part.column(2)):
                    made = response(u.as_py(), p.as_py(), date)
                    data += [serialize(*made), *(serialize(*d) for d in derive_one(*made))]
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), len(KINDS))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(KINDS * part.num_rows), pa.array(data, pa.binary())], names=["page_id", "kind", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, kind string, record binary")


def digests(records: DataFrame) -> DataFrame:
    """The header fields of records, one row each, with the SHA-256 of the whole record."""
    head = F.substring_index(F.decode("record", "UTF-8"), "\r\n\r\n", 1)
    get = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)", 1)
    out = records.select("page_id", "kind", head.alias("head"), F.sha2("record", 256).alias("record_sha256"))
    return out.select(
        "page_id", F.col("kind").alias("record_type"), get("WARC-Record-ID").alias("record_id"), get("WARC-Refers-To").alias("refers_to"), get("WARC-Target-URI").alias("target_uri"),
        F.coalesce(F.nullif(get("WARC-Payload-Digest"), F.lit("")), get("WARC-Source-Payload-Digest")).alias("payload_digest"), get("WARC-Block-Digest").alias("block_digest"),
        get("Content-Length").cast("bigint").alias("content_length"), "record_sha256",
    )
