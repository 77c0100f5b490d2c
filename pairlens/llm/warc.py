"""WARC archives: writing with deduplication and segmentation, reading with segment reassembly.

Writing: payloads become HTTP responses with chunked transfer framing. Of records with equal payloads
the one with the largest id is the ``response``; the others are ``revisit`` records that refer to its
record id. The rest move as ids and digests.
Record ids follow from the content (id, digest, url, number of the copy). A block longer than
``segment_bytes`` is cut: the first segment keeps the record's type, the rest are ``continuation``
records with the origin's id, a segment number and, on the last, the total length. Every record is a
gzip member of its own (the two line ends after it are another); files are written by Spark's text
sink on any file system that Spark writes to, and named ``.warc.gz``; a task rolls to a new file after
``archive_records`` records.

Reading: every archive file is parsed on its own, segments are grouped by origin, ordered by number,
checked for gaps and against the total length, joined, and the HTTP framing is taken off: chunked if the
head says so, else the stated length or the rest. A ``response`` that is no HTTP message is its
own payload. A record that fails a check, and each damaged or cut-off stretch of a file, is a row with ``error`` set; what
can be read around it is returned.

Defined results: a null payload is the empty payload; null ids are written as ``null`` and never win
over another id; of rows of equal id and payload the one whose url sorts last is the response, and
rows that repeat in all three are copies that revisit the first. Payloads of any length are cut into
segments. Records without a payload digest are not checked against one. An empty table reads back as
no rows. Other columns of the pages are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, rename_files

STEP = 1 << 16
GZIP = b"\x1f\x8b"
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
CHUNK_SIZE, LENGTH = re.compile(rb"[0-9A-Fa-f]{1,16}"), re.compile(r"[0-9]{1,18}")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError where it is none."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        digits = body[at:line].split(b";")[0].rstrip(b" \t")
        if not CHUNK_SIZE.fullmatch(digits):
            raise ValueError("chunk without its size")
        size = int(digits, 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without its line end")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message as its head frames it: chunked, of a stated length, or up to the end."""
    head, found, body = block.partition(END)
    if not found:
        raise ValueError("no HTTP head")
    lines = head.decode("latin1").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if fields.get("transfer-encoding", "").split(",")[-1].strip().lower() == "chunked":
        return unchunked(body)
    length = fields.get("content-length", "")
    if not LENGTH.fullmatch(length):
        return body
    if len(body) < int(length):
        raise ValueError("body is shorter than its length")
    return body[: int(length)]


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without the two line ends that close it."""
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def records(stream: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of a decompressed stretch; ValueError where it is damaged."""
    at = 0
    while at < len(stream):
        if stream[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = stream.find(END, at)
        if stop < 0 or stream[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        lines = stream[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = fields.get("content-length", "")
        if not LENGTH.fullmatch(size) or "warc-type" not in fields:
            raise ValueError("record without length or type")
        at = stop + 4 + int(size)
        if at > len(stream):
            raise ValueError("record is cut off")
        yield fields, stream[stop + 4 : at]


def entries(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(fields, block, error) of each record of a file, plain or of gzip members; after damage the next member goes on."""
    at = 0
    while at < len(archive):
        error = None
        if archive[at : at + 2] == GZIP:
            coder, parts, after = zlib.decompressobj(31), [], at
            try:
                while not coder.eof and after < len(archive):  # a step at a time: the rest of the file belongs to other members
                    parts.append(coder.decompress(archive[after : after + STEP]))
                    after = min(after + STEP, len(archive))
                after -= len(coder.unused_data)
                error = None if coder.eof else "archive is cut off"
            except zlib.error as e:
                error = f"damaged gzip member: {e}"
                after = archive.find(GZIP, at + 2)
                after = len(archive) if after < 0 else after
            stream = b"".join(parts)
        else:
            stream, after = archive[at:], len(archive)
        try:
            for fields, block in records(stream):
                yield fields, block, None
        except ValueError as e:
            error = error or str(e)
        if error:
            yield {}, b"", error
        at = after


def _written(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    """(id, url, sha1, copy, to, payload) rows to write: ``to`` is null and ``payload`` set for responses."""
    payload = F.coalesce(col(html).cast("string"), F.lit("")).cast("binary")
    own = pages.select(
        col(page_id).cast("long").alias("id"),
        F.coalesce(F.regexp_replace(col(url).cast("string"), r"[\r\n]", ""), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
    )
    place = F.struct("id", "url")
    winners = own.groupBy("sha1").agg(F.max_by(F.struct("id", "url", "payload"), place).alias("w"))
    light = cut(own.groupBy("sha1", "id", "url").agg(F.count(F.lit(1)).alias("copies")))
    best = light.groupBy(F.col("sha1").alias("of")).agg(F.max(place).alias("w"))
    others = light.join(best, F.col("sha1") == F.col("of")).withColumn("first", (F.col("id").eqNullSafe(F.col("w.id")) & (F.col("url") == F.col("w.url"))).cast("int"))
    others = others.where("copies > first").select("id", "url", "sha1", F.explode(F.sequence(F.col("first").cast("long"), F.col("copies") - 1)).alias("copy"), F.col("w").alias("to"), F.lit(None).cast("binary").alias("payload"))
    responses = winners.select("w.id", "w.url", "sha1", F.lit(0).cast("long").alias("copy"), F.lit(None).cast(others.schema["to"].dataType).alias("to"), "w.payload")
    return responses.unionByName(others)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = 16 << 10, chunk_bytes: int = 4 << 10, archive_records: int = 4000) -> None:
    """Write all pages under ``path`` as ``.warc.gz`` archives."""

    def uid(number: int | None, address: str, sha1: str, copy: int) -> str:
        place = hashlib.md5(address.encode()).hexdigest()[:16]
        return f"<urn:page:{'null' if number is None else number}:{sha1}:{place}:{copy}>"

    def member(content: bytes) -> bytes:
        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
        return coder.compress(content) + coder.flush()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            for r in batch.to_pylist():
                own = uid(r["id"], r["url"], r["sha1"], r["copy"])
                common = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", r["url"]), ("Content-Type", "application/http; msgtype=response")]
                digest = ("WARC-Payload-Digest", "sha1:" + base32_sha1(r["sha1"]))
                if r["to"] is not None:
                    to = [("WARC-Refers-To", uid(r["to"]["id"], r["to"]["url"], r["sha1"], 0)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                    out.append(member(record("revisit", [*common, digest, *to], HTTP)))
                    continue
                block = HTTP + chunked(r["payload"], chunk_bytes)
                pieces = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
                number = [("WARC-Segment-Number", "1")] if len(pieces) > 1 else []
                out.append(member(record("response", [*common, digest, *number], pieces[0])))
                for k, piece in enumerate(pieces[1:], 2):
                    last = [("WARC-Segment-Total-Length", str(len(block)))] if k == len(pieces) else []
                    out.append(member(record("continuation", [("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), *last], piece)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    encoded = _written(pages, page_id, url, html).mapInArrow(encode, "record binary")
    lines = encoded.select(F.col("record").cast("string").alias("value"))  # bytes as they are; the separator is a gzip member
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", member(END).decode("latin1")).option("maxRecordsPerFile", archive_records).text(path)
    rename_files(pages.sparkSession, path, ".txt", ".warc.gz")


_PART = "id string, type string, digest string, refers string, origin string, number int, total long, block binary, error string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"id": pa.string(), "type": pa.string(), "digest": pa.string(), "refers": pa.string(), "origin": pa.string(), "number": pa.int32(), "total": pa.int64(), "block": pa.binary(), "error": pa.string()}
    whole = lambda text: int(text) if text and LENGTH.fullmatch(text) else None
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for f, block, error in entries(content.as_py()):
                uid, number = f.get("warc-record-id"), whole(f.get("warc-segment-number"))
                number = number if number is None or number < 1 << 31 else 0
                origin = f.get("warc-segment-origin-id", uid if number is not None else None)
                rows.append((uid, f.get("warc-type"), f.get("warc-payload-digest"), f.get("warc-refers-to"), origin, number, whole(f.get("warc-segment-total-length")), block, error))
                if len(rows) == 256:
                    yield _batch(rows, kinds)
                    rows = []
            if rows:
                yield _batch(rows, kinds)


def _batch(rows: list, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record: id, type, digest, refers, payload (null for revisits), payload_bytes, error."""
    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content").mapInArrow(_parse, _PART)
    whole = parsed.where(F.col("number").isNull()).select("id", "type", "digest", "refers", F.array("block").alias("blocks"), "error")
    # a group is one record's segments; the list is as large as that record
    parts = F.array_sort(F.collect_list(F.struct("number", "type", "digest", "block", "total")))
    groups = parsed.where(F.col("number").isNotNull()).groupBy("origin").agg(parts.alias("s"))
    count, head, last = F.size("s"), F.col("s")[0], F.element_at("s", -1)
    gapless = head["number"].eqNullSafe(1) & last["number"].eqNullSafe(count) & (F.size(F.array_distinct(F.col("s.number"))) == count)
    total = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["block"]))
    groups = groups.select(
        F.col("origin").alias("id"),
        head["type"].alias("type"),
        head["digest"].alias("digest"),
        F.lit(None).cast("string").alias("refers"),
        F.col("s.block").alias("blocks"),
        F.when(~gapless, "segment missing or repeated").when(~total.eqNullSafe(last["total"]), "total length differs").alias("error"),
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload, error, size = [], batch.column(5).to_pylist(), []
            for i, (kind, digest, blocks) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4))):
                value = None
                if kind == "response" and error[i] is None:
                    block = b"".join(blocks.as_py())
                    try:
                        value = http_payload(block) if block.startswith(b"HTTP/") else block
                        if digest and digest != "sha1:" + base64.b32encode(hashlib.sha1(value).digest()).decode():
                            error[i] = "payload digest differs"
                    except ValueError as e:
                        error[i] = f"broken HTTP framing: {e}"
                payload.append(value)
                size.append(None if value is None else len(value))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(payload, pa.binary()), pa.array(size, pa.int64()), pa.array(error, pa.string())], names=["id", "type", "digest", "refers", "payload", "payload_bytes", "error"])

    return whole.unionByName(groups).mapInArrow(decode, "id string, type string, digest string, refers string, payload binary, payload_bytes long, error string")


def page_of(uid: Column) -> Column:
    """The page id inside a record id or a reference to one."""
    return F.regexp_extract(uid, r"^<urn:page:(-?\d+|null)", 1)
