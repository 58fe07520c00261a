"""Operator 2: WARC archives, written by Spark's text writer and read by a salvage reader."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An empty gzip member. It stands between records where the text writer wants a line end; readers of gzip skip it.
SEPARATOR = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: When the archives were made is no property of the rows; a fixed date keeps reruns equal.
DATE = "1970-01-01T00:00:00Z"
RECORDS_PER_FILE = 20_000

FIELDS = {
    "file": pa.string(), "offset": pa.int64(), "length": pa.int64(), "kind": pa.string(), "reason": pa.string(),
    "page_id": pa.int64(), "record_type": pa.string(), "refers_to": pa.int64(), "target": pa.string(),
    "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary(),
    "inner_offset": pa.int64(), "inner_length": pa.int64(),
}
SCHEMA = (
    "file string, offset long, length long, kind string, reason string, page_id long, record_type string, refers_to long, "
    "target string, payload_bytes long, payload_digest string, payload binary, inner_offset long, inner_length long"
)
#: Decompressed bytes handled at a time while a member is checked.
STEP = 1 << 20


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, original: int | None, response: bool) -> bytes:
    """One record. A revisit has the HTTP head of its page, with the length of the payload, but not the payload."""
    digest = sha1_base32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if response else head
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {urn(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if not response:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {urn(original)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def originals(pages: DataFrame, key: str, url: str, html: str, least: int) -> DataFrame:
    """page_id, url, html, original: of equal payloads of at least ``least`` bytes the largest page_id.

    Rows are compared by digest; the largest key of each digest is found on narrow rows, summed up before the shuffle.
    """
    text = F.coalesce(pages[html].cast("string"), F.lit(""))
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumn("sum", F.unhex(F.sha1(F.col("html").cast("binary"))))
    largest = rows.where(F.octet_length("html") >= least).groupBy("sum").agg(F.max("page_id").alias("original"))
    return rows.join(largest, "sum", "left").select("page_id", "url", "html", "original")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record per row, each a gzip member of its own, to files in ``folder``.

    Of rows with equal payloads of at least ``least`` bytes, that with the largest key is a response and the others
    revisits of it; smaller ones are all responses. Null html is the empty payload. A null key never is the largest; rows
    of null keys are responses if no equal payload has a key. Rows that repeat the largest key are all responses. An empty
    table makes no records.

    Spark's text writer commits the files, so a task that is lost or runs twice leaves no half file or second copy, on
    any storage that Spark writes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, address, text, original in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, original = page.as_py(), original.as_py()
                made = record(page, address.as_py(), text.as_py().encode(), original, original is None or original == page)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(pack.compress(made) + pack.flush())
                held += len(out[-1])
                if held > STEP * 8:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    packed = originals(pages, key, url, html, least).mapInArrow(run, "record binary")
    lines = packed.select(F.col("record").cast("string").alias("value"))
    separator = SEPARATOR.decode("latin-1")
    writer = lines.write.option("lineSep", separator).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file)
    writer.text(folder)


def member(data: memoryview, start: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``start``; None if it is cut off or fails its checksum."""
    unpack = zlib.decompressobj(31)
    out = []
    try:
        for at in range(start, len(data), STEP):
            out.append(unpack.decompress(data[at : at + STEP]))
            if unpack.eof:
                return b"".join(out), min(at + STEP, len(data)) - len(unpack.unused_data)
    except zlib.error:
        return None
    return None


def fields(content: bytes, at: int = 0) -> tuple[dict[str, str], int] | None:
    """Header fields by lower-case name and where the block begins, for a record at ``at``; a header may have any length."""
    end = content.find(b"\r\n\r\n", at)
    if not content.startswith(VERSION, at) or end < 0:
        return None
    lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def whole(content: bytes, at: int = 0) -> tuple[dict, int] | str:
    """The checked record at ``at`` and where it ends, or why it fails."""
    found = fields(content, at)
    if found is None:
        return "no version line or header end"
    head, start = found
    if not re.fullmatch(r"\d{1,18}", size := head.get("content-length", "")):
        return "no content length"
    end = start + int(size)
    if content[end : end + 4] != b"\r\n\r\n":
        return "length does not match the record end"
    block = content[start:end]
    if (stated := head.get("warc-block-digest", "")) and stated.removeprefix("sha1:") != sha1_base32(block):
        return "block digest differs"
    kind = head.get("warc-type")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != sha1_base32(payload):
        return "payload digest differs"
    length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})\r?$", http)
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))) else None
    return {
        "page_id": page("warc-record-id"), "record_type": kind, "refers_to": page("warc-refers-to"), "target": head.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None,
        "payload_digest": digest or None, "payload": payload if kind == "response" else None,
    }, end + 4


def plain_records(content: bytes, at: int = 0) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) for each record from ``at`` on, and (start, end, reason) for what lies between them.

    After a failure the search goes on at the next version line whose record passes all checks.
    """
    bad, why = None, ""
    while at < len(content):
        one = whole(content, at) if content.startswith(VERSION, at) else "no version line"
        if isinstance(one, str):
            if bad is None:
                bad, why = at, one
            later = content.find(VERSION, at + 1)
            at = later if later >= 0 else len(content)
            continue
        if bad is not None:
            yield bad, at, why
            bad = None
        yield at, one[1], one[0]
        at = one[1]
    if bad is not None:
        yield bad, len(content), why


def salvage(data: bytes, keep_payload: bool = True) -> Iterator[dict]:
    """Records of an archive, compressed by member or plain, and a ``gap`` for each stretch that no check lets through.

    After a failure the search goes on at the next gzip magic or version line behind the failed start; only a start
    whose record passes all checks ends the gap, so a chance pattern inside damaged bytes does not. A member that unpacks
    whole but holds several records, some of them damaged, is searched the same way inside: its good records come out, and
    a gap for each bad stretch. Rows from such a member have the member's offset and length, and their place in its
    unpacked bytes as ``inner_offset`` and ``inner_length``, which are null for a plain record or a member of one record.
    """
    view, at, bad, why = memoryview(data), 0, None, ""
    starts = re.compile(re.escape(GZIP) + b"|" + re.escape(VERSION))
    while at < len(data):
        found: list[tuple[int, int, dict | str]] | str = "neither a member nor a version line"
        end = at
        if data.startswith(GZIP, at):
            unpacked = member(view, at)
            if unpacked is None:
                found = "member is cut off or fails its checksum"
            else:
                content, end = unpacked
                inside = list(plain_records(content))
                found = inside if any(isinstance(one, dict) for *_, one in inside) or not inside else inside[0][2]
        elif data.startswith(VERSION, at):
            one = whole(data, at)
            if isinstance(one, str):
                found = one
            else:
                found, end = [(0, one[1] - at, one[0])], one[1]
        if isinstance(found, str):
            if bad is None:
                bad, why = at, found
            later = starts.search(data, at + 1)
            at = later.start() if later else len(data)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        for start, stop, one in found:
            place = {"offset": at, "length": end - at}
            if len(found) > 1:
                place |= {"inner_offset": start, "inner_length": stop - start}
            if isinstance(one, str):
                yield {"kind": "gap", "reason": one, **place}
            else:
                yield {"kind": "record", "reason": None, **place, **(one if keep_payload else one | {"payload": None})}
        at = end
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": why}


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of all archives in ``folder``.

    file, offset and length say where a record or gap lies, inner_offset and inner_length where in a member of several
    records; a gap has the reason of its first failure and nothing else.
    Revisits have the payload's length and digest from their head and no payload. Records of other writers have a null
    page_id. A folder without records gives no rows. Files are read whole, so they are best kept to some 100 MB.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                out, held = [], 0
                for row in salvage(content.as_py(), keep_payload):
                    out.append(row | {"file": path.as_py()})
                    held += len(row.get("payload") or b"") + 200
                    if held > STEP * 8:
                        yield rows(out)
                        out, held = [], 0
                yield rows(out)

    def rows(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in found], t) for k, t in FIELDS.items()], list(FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
