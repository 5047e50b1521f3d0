"""WARC archives: pages written as response and revisit records, in segments, and read back.

A record's block is an HTTP answer in chunked transfer framing. A block over a segment's bytes is cut,
between characters, into a first record and continuation records that name its id as origin, are
numbered, and give the total length in the last. Spark's text writer puts the records into
compressed files, two line ends after each as the format asks, so a task that runs again leaves no half
file. Reading takes archives of one or many compressed members, skips records that are neither response, revisit nor
continuation, groups segments by origin, orders them by number, verifies the total length, decodes the chunks and verifies the
payload's digest; a revisit is compared with the response it names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

SEGMENT, CHUNK = 1 << 13, 1 << 12
#: Records of one file; at a segment's bytes each they are read at once.
RECORDS = 1000
#: Payloads under so many bytes are never revisits.
LEAST = 100
#: Rows of repeated payloads up to which they are sent to all tasks.
FEW = 100_000
_END = "\r\n\r\n"
_DATE = "1970-01-01T00:00:00Z"  # the table has none


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        at = end + 4 + n


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block


def segments(block: bytes, most: int = SEGMENT) -> list[bytes]:
    out, at = [], 0
    while len(block) - at > most:
        end = at + most
        while block[end] & 0xC0 == 0x80:
            end -= 1
        out.append(block[at:end])
        at = end
    return [*out, block[at:]]


def with_digests(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, html, digest, bytes, refers_to)."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumns({"digest": F.sha2("html", 256), "bytes": F.octet_length("html")})
    first = page.where((F.col("bytes") >= LEAST) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = store.saved(first, store.shared_dir(pages.sparkSession, "warc"), "repeated")
    if first.count() <= FEW:
        first = F.broadcast(first)
    return page.join(first, "digest", "left").withColumn("refers_to", F.when(F.col("first") != F.col("page_id"), F.col("first"))).drop("first")


def write(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Archives of all rows of ``pages`` (page_id, url, html) in the folder ``path``, in records of ``segment`` bytes at most.

    Null and repeated values as in ``round_trip``; an empty table gives a folder without records.
    """

    def build(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page, url, html, digest, size, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "bytes", "refers_to"))):
                own = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{part}/{row}/{page}'.encode()).digest())}>"
                row += 1
                kind = "response" if refers is None else "revisit"
                target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                parts = segments(http + (chunked(html.encode("utf-8", "surrogatepass")) if refers is None else b""), segment)
                head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size), ("Content-Type", "application/http; msgtype=response")]
                if refers is not None:
                    head += [("WARC-Refers-To", f"<urn:x-page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                if len(parts) > 1:
                    head.append(("WARC-Segment-Number", 1))
                out.append(record(head, parts[0]))
                for i, p in enumerate(parts[1:], 2):
                    total = sum(map(len, parts)) if i == len(parts) else None
                    mine = f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{own}{i}'.encode()).digest())}>"
                    out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", mine), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", total)], p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = with_digests(pages).select("page_id", "url", "html", "digest", "bytes", "refers_to").mapInArrow(build, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def unzipped(data: bytes) -> bytes:
    """All members of a compressed archive, or an archive that is not compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        if not member.eof:
            raise ValueError("a compressed member is cut off")
        data = member.unused_data
    return b"".join(out) + data


def records(data: bytes):
    """Headers and block of each record of an archive."""
    data, at = unzipped(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(head["content-length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError("a record is not as long as it says")
        yield head, block
        at = end + 8 + n


def same_digest(payload: bytes, said: str) -> bool:
    """Whether a digest header, of an algorithm known here, fits: in hex or base 32."""
    kind, _, value = said.partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def answer(head: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole record; what a record of another writer does not say is null."""
    number = lambda name, pattern: int(m[1]) if (m := re.fullmatch(pattern, head.get(name, ""))) else None
    page, said = number("x-page-id", r"(-?\d+)"), head.get("warc-payload-digest", "")
    if head["warc-type"] == "revisit":
        digest = said.removeprefix("sha256:") if said.startswith("sha256:") else None
        return page, number("x-payload-length", r"(\d+)"), digest, "revisit", number("warc-refers-to", r"<urn:x-page:(-?\d+)>")
    http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    payload = dechunked(body) if b"transfer-encoding: chunked" in http.lower() else body
    if not same_digest(payload, said) or "x-payload-length" in head and len(payload) != int(head["x-payload-length"]):
        raise ValueError(f"the payload of page {page} is not what its record says")
    return page, len(payload), hashlib.sha256(payload).hexdigest(), "response", None


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark, path: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of all archives in ``path``, .warc or .gz.

    Repeated records give a row each, other record types none; a folder without records gives no rows. A revisit whose digest or
    length is not that of the response it names is an error; one that names a response which is not here stays as it is.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def parse(batches):
        types = [*kinds, pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for head, block in records(data.as_py()):
                    if head.get("warc-type") not in ("response", "revisit", "continuation"):
                        continue
                    n = int(head.get("warc-segment-number", 0))
                    if n:
                        keys = "\n".join(f"{k}: {v}" for k, v in head.items()) if n == 1 else ""
                        rows.append((None,) * 5 + (head["warc-record-id"] if n == 1 else head["warc-segment-origin-id"], n, int(head.get("warc-segment-total-length", 0)), keys, block))
                    else:
                        rows.append((*answer(head, block), head["warc-record-id"], 0, 0, "", None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    names = [x.split()[0] for x in _OUT.split(", ")] + ["origin", "segment", "total", "head", "block"]
    parsed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content").mapInArrow(parse, f"{_OUT}, origin string, segment int, total long, head string, block binary")

    def whole(batches):
        held: list[tuple] = []

        def done():
            if not held:
                return []
            block = b"".join(b for _, _, _, b in held)
            if [n for n, _, _, _ in held] != list(range(1, len(held) + 1)) or held[-1][1] != len(block):
                raise ValueError("segments are missing, or their length is not the total")
            return [answer(dict(x.split(": ", 1) for x in held[0][2].split("\n")), block)]

        origin = None
        for batch in batches:
            rows = []
            for r in zip(*(batch.column(n).to_pylist() for n in names)):
                if r[6] and r[5] == origin:
                    held.append(r[6:])
                    continue
                rows += done()
                origin, held = (r[5], [r[6:]]) if r[6] else (None, [])
                if not r[6]:
                    rows.append(r[:5])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:5])
        if rows := done():
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names[:5])

    rows = parsed.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(whole, _OUT)
    rows = store.saved(rows, store.shared_dir(spark, "warc"), "read")
    named = rows.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.min("payload_bytes").alias("b"), F.min("payload_digest").alias("d1"), F.max("payload_digest").alias("d2"))
    both = rows.where("refers_to is not null").join(named, "refers_to", "left")
    wrong = (F.col("d1") != F.col("payload_digest")) & (F.col("d2") != F.col("payload_digest")) | (F.col("d1") == F.col("d2")) & (F.col("b") != F.col("payload_bytes"))
    sound = both.withColumn("record_type", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a revisit is not what the response it names is"))).otherwise(F.col("record_type")))
    return rows.where("refers_to is null").unionByName(sound.select(*rows.columns))


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives of ``pages``.

    A null html counts as empty, a null url gives no target. Of equal payloads of 100 bytes or more, the rows with the
    smallest page_id are responses, all others revisits of it; a null page_id is never referred to, and its row is a
    revisit only if another row's page_id is known. Other columns are ignored; an empty table gives no rows.
    """
    path = store.shared_dir(pages.sparkSession, "warc") + "/archives"
    write(pages, path, segment)
    return read(pages.sparkSession, path)
