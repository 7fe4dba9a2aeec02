"""WARC archives: a writer with revisit records and a salvage reader.

Records are written one gzip member each, through Spark's own text sink, whose commit protocol makes lost executors
harmless and reaches any store that Spark can write; the line separator is an empty gzip member, so a file is a plain
concatenation of members that any gzip reader accepts. The salvage reader checks every member and record (gzip CRC,
version line, length, record end, block and payload digest). After a failed check it searches for the next valid
member or version line, goes on there, and logs the bytes between as a quarantined gap; inside a member it searches the
inflated bytes. Of a member that is cut short or broken, what can be inflated is searched too; where gzip finds wrong
bytes, only records with a digest of their own are taken.

Defined results: a null html is an empty payload; of records with equal payloads of at least ``least`` bytes the one
with the smallest page_id is the response and the others revisit it (rows that repeat the smallest page_id are all
responses); a null page_id is written as an id of its own and can only be a response or a revisit; control characters
of a url are percent-encoded, a null url leaves the target out; an empty table writes no record; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keep, slices

#: Payload bytes and records of one archive file at most (a larger payload has a file of its own); a task reads a file as a whole.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 4_000
#: Payloads that several pages have are broadcast up to this number (some 100 bytes each); beyond it revisits are joined by page and digest.
BROADCAST_REPEATED = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_ID = re.compile(r"<urn:page:(-?\d+|null)>")


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    """An uncompressed WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The response or revisit record of a page."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return record(fields, block)


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.withColumns({"sha": F.sha1(payload), "size": F.length(payload)})


def _refers(page_id: Column, first: Column) -> Column:
    return F.when(page_id.isNull() | (page_id != first), first)


def repeated(pages: DataFrame, least: int = 0) -> DataFrame:
    """(sha, size, first) of the payloads that several rows have; digests only are shuffled."""
    seen = _digested(pages).where(f"size >= {least}").select("page_id", "sha", "size")
    return seen.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").drop("k")


def write(pages: DataFrame, path: str, least: int = 0, level: int = 4, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for every row (page_id, url, html) to gzip archives below ``path``, a folder for each class of sizes."""
    first = keep(repeated(pages, least))
    src = _digested(pages.select("page_id", "url", "html"))
    if first.count() <= BROADCAST_REPEATED:
        src = src.join(F.broadcast(first), ["sha", "size"], "left").withColumn("refers_to", _refers(F.col("page_id"), F.col("first")))
    else:  # what is shuffled by digest, a hot key, are ids; pages are shuffled by id and digest
        again = src.select("page_id", "sha", "size").distinct().join(first, ["sha", "size"])
        again = again.select(F.col("page_id").alias("id"), F.col("sha").alias("of"), _refers(F.col("page_id"), F.col("first")).alias("refers_to")).where("refers_to is not null")
        src = src.join(again, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("of")), "left")
    src = src.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to", "size")

    def run(batches):
        for batch in slices(batches, "html"):
            ids, urls, bodies, refers = (c.to_pylist() for c in batch.columns)
            out = []
            for i, u, b, r in zip(ids, urls, bodies, refers, strict=True):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.append(z.compress(page_record(i, u, b or b"", r)) + z.flush())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    sep = EMPTY_MEMBER.decode("latin-1")
    # Classes of sizes, 16 times as large each, with so many records a file that its bytes stay bounded.
    least_class = max(1, file_bytes // records_per_file)
    sizes = [least_class * 16**k for k in range(8)]
    known = pages.agg(*(F.count_if(F.length(F.coalesce(F.col("html").cast("binary"), F.lit(b""))).between(sizes[k - 1] + 1 if k else 0, most)).alias(str(k)) for k, most in enumerate(sizes))).first()
    for k, most in enumerate(sizes):
        if known[str(k)] or (k == 0 and not any(known)):
            part = src.where(F.col("size").between(sizes[k - 1] + 1 if k else 0, most)).drop("size")
            members = part.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
            per = max(1, min(records_per_file, file_bytes // most))
            members.write.option("encoding", "ISO-8859-1").option("lineSep", sep).option("maxRecordsPerFile", per).text(f"{path}/sizes-{k}")


def _plain(data: memoryview, at: int, raw: bytes) -> tuple[dict, bytes, int] | str:
    """The record at ``at`` as (fields, block, end), or why it fails."""
    m = _VERSION.match(raw, at)
    if not m:
        return "no version line"
    fields, pos = {}, m.end()
    while (end := raw.find(b"\r\n", pos)) != pos:
        if end < 0:
            return "no end of header"
        name, colon, value = raw[pos:end].partition(b":")
        if not colon:
            return "broken header line"
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
        pos = end + 2
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return "no length"
    start = end + 2
    stop = start + int(size)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return "no end of record"
    block = bytes(data[start:stop])
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", None if fields.get("warc-type") == "revisit" else _payload(block))):
        said = fields.get(name, "")
        if part is not None and said.lower().startswith("sha1:") and said[5:].upper() != digest(part):
            return name.removeprefix("warc-") + " differs"
    return fields, block, stop + 4


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The gzip member at ``at`` as (content, end, fault); with a fault, what could be inflated and where that stopped."""
    z, out, pos = zlib.decompressobj(31), [], at
    while not z.eof:
        if pos >= len(data):
            return b"".join(out), len(data), "member cut short"
        before = z.copy()
        try:
            out.append(z.decompress(data[pos : pos + 65536]))
        except zlib.error as e:
            # A failed call gives no output at all: once more, byte by byte.
            try:
                while True:
                    out.append(before.decompress(data[pos : pos + 1]))
                    pos += 1
            except zlib.error:
                return b"".join(out), pos, f"gzip: {e}"[:80]
        pos += 65536
    return b"".join(out), min(pos, len(data)) - len(z.unused_data), ""


def _inside(content: bytes, sure: bool) -> list[tuple]:
    """("record", start, end, fields, block) and ("gap", start, end, reason) of inflated bytes, in order.

    If the member is not ``sure``, a record is one only with a digest that tells its bytes.
    """
    inner, out, pos, bad, why = memoryview(content), [], 0, -1, ""
    while pos < len(content):
        rec = _plain(inner, pos, content)
        if not isinstance(rec, str) and not sure and not any(rec[0].get(k, "").lower().startswith("sha1:") for k in ("warc-block-digest", "warc-payload-digest")[: 1 + (rec[0].get("warc-type") != "revisit")]):
            rec = "no digest in a broken member"
        if isinstance(rec, str):
            if bad < 0:
                bad, why = pos, rec
            pos = k if (k := content.find(b"WARC/1.", pos + 1)) >= 0 else len(content)
            continue
        if bad >= 0:
            out.append(("gap", bad, pos, why))
            bad = -1
        out.append(("record", pos, rec[2], rec[0], rec[1]))
        pos = rec[2]
    if bad >= 0:
        out.append(("gap", bad, len(content), why))
    return out


def salvage(raw: bytes):
    """Yields ("record", start, end, fields, block) and ("gap", start, end, reason) of an archive's bytes, in order.

    A gap inside a member that has records has the member's start and end, and its inflated bytes in the reason.
    """
    data, at, bad, why = memoryview(raw), 0, -1, ""
    stop, seen = 0, []  # a broken member's bytes, and its records, which stored blocks show once more
    while at < len(raw):
        found, reason, end = [], "", -1
        if raw.startswith(_MEMBER, at):
            content, upto, reason = _member(data, at)
            found = _inside(content, not reason.startswith("gzip"))
            if not reason:
                end = upto
                reason = next((x[3] for x in found if x[0] == "gap"), "")
            elif any(x[0] == "record" for x in found):
                stop, seen = max(upto, stop), seen + [x[3:] for x in found if x[0] == "record"]
                found.append(("gap", len(content), len(content), reason))
        else:
            rec = _plain(data, at, raw)
            if isinstance(rec, str):
                reason = rec
            elif at < stop and rec[:2] in seen:
                reason = "record of a broken member"
            else:
                found, end = [("record", 0, 0, *rec[:2])], rec[2]
        if at >= stop:
            seen = []
        if end < 0:
            end = min((k for k in (raw.find(_MEMBER, at + 1), raw.find(b"WARC/1.", at + 1)) if k >= 0), default=len(raw))
        if reason and not any(x[0] == "record" for x in found):
            if bad < 0:
                bad, why = at, reason
            at = end
            continue
        if bad >= 0:
            yield ("gap", bad, at, why)
            bad = -1
        for kind, start, to, *more in found:
            yield ("record", at, end, *more) if kind == "record" else ("gap", at, end, f"{more[0]} (inflated bytes {start} to {to})")
        at = end
    if bad >= 0:
        yield ("gap", bad, len(raw), why)


def read(spark: SparkSession, path: str) -> DataFrame:
    """What is in the archives below ``path``: records, and gaps with the reason; one task reads a file, of 2 GB at most.

    kind (record or gap), file, start, end, reason, record_type, page_id, refers_to, url, payload, payload_bytes and
    payload_digest; a revisit has the full payload's size and digest and no payload.
    """
    schema = "kind string, file string, start long, end long, reason string, record_type string, page_id long, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"

    def rows(file: str, raw: bytes):
        for kind, start, end, *more in salvage(raw):
            if kind == "gap":
                yield (kind, file, start, end, more[0], *[None] * 7)
                continue
            fields, block = more
            ids = [m[1] if (m := _ID.search(fields.get(k, ""))) and m[1] != "null" else None for k in ("warc-record-id", "warc-refers-to")]
            revisit = fields.get("warc-type") == "revisit"
            payload = None if revisit else _payload(block)
            size = re.search(rb"\r\nContent-Length: *(\d+)", block) if revisit else None
            yield (
                kind, file, start, end, None, fields.get("warc-type"), *(None if x is None else int(x) for x in ids), fields.get("warc-target-uri"),
                payload, (int(size[1]) if size else None) if revisit else len(payload), fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest(payload),
            )

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches):
        for batch in slices(batches, "content"):
            for file, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, size = [], 0
                for r in rows(file, raw):
                    out.append(r)
                    size += len(r[9] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pydict({f.name: [x[i] for x in out] for i, f in enumerate(arrow)}, schema=arrow)
                        out, size = [], 0
                yield pa.RecordBatch.from_pydict({f.name: [x[i] for x in out] for i, f in enumerate(arrow)}, schema=arrow)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def op2(spark, pages: DataFrame) -> DataFrame:
    """The contract's columns: every page written, read back and described; an error if a record was lost."""
    with Scratch(spark, "warc") as tmp:
        write(pages, f"{tmp.root}/archives")
        out = keep(read(spark, f"{tmp.root}/archives").select("kind", "reason", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    got = out.agg(F.count_if(F.col("kind") == "record").alias("records"), F.first(F.when(F.col("kind") == "gap", F.col("reason")), ignorenulls=True).alias("gap")).first()
    n = pages.count()
    if got.records != n or got.gap:
        raise RuntimeError(f"{got.records} of {n} records came back; first gap: {got.gap}")
    return out.drop("kind", "reason")
