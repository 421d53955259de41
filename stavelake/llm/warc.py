"""WARC: archive writer with revisits, and a salvage reader.

Defined results: a null payload is empty; a null id or URL leaves out the header and is null again when read; rows
that repeat an id are all written (all rows with the largest id of a group of equal payloads are responses); an empty
table writes no archive.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import delete, discard, lean, may_hold, salted_group_value, storage, stored, work_dir

MAGIC, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
STEP = 1 << 20

RECORD_SCHEMA = (
    "file string, offset long, end long, status string, reason string, record_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
)


def _sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_safe(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def make_record(kind: str, record_id: str | None, uri: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One record, uncompressed.  A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id or 'urn:uuid:' + str(uuid.uuid4())}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{_sha1_32(payload)}",
        f"WARC-Block-Digest: sha1:{_sha1_32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_header_safe(uri)}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{refers_to}>")
    return "\r\n".join(head).encode() + END + block + END


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damage(ValueError):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place after it; Damage if any check fails."""
    if not data.startswith(VERSION, at):
        raise Damage("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damage("header without end")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Damage("no content length")
    begin = stop + 4
    over = begin + int(fields["content-length"])
    if len(data) < over + 4:
        raise Damage("short block")
    if data[over : over + 4] != END:
        raise Damage("no record end")
    block = data[begin:over]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{_sha1_32(block)}":
        raise Damage("block digest differs")
    kind = fields.get("warc-type")
    digest = size = payload = None
    if kind in ("response", "revisit"):
        http, _, payload = block.partition(END)
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response":
            digest, size = _sha1_32(payload), len(payload)
            if said and said != digest:
                raise Damage("payload digest differs")
        else:
            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            digest, size, payload = said or None, int(length[1]) if length else None, None
    bare = lambda x: x and x.strip("<>")
    return {
        "record_type": kind,
        "record_id": bare(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload_digest": digest and base64.b32decode(digest).hex(),
        "payload_bytes": size,
        "payload": payload,
    }, over + 4


def _records_in(data: bytes, at: int = 0) -> Iterator[tuple[int, int, dict | str]]:
    """(begin, end, record or damage) over plain bytes, resynchronised at version lines."""
    while at < len(data):
        try:
            record, end = parse_record(data, at)
            yield at, end, record
        except Damage as why:
            end = at
            while True:
                end = data.find(VERSION, end + 1)
                if end < 0:
                    end = len(data)
                    break
                try:
                    parse_record(data, end)
                    break
                except Damage:
                    continue
            yield at, end, str(why)
        at = end


class _Window:
    """Random access to a stream read once from front to back; ``drop`` frees what lies behind."""

    def __init__(self, stream):
        self.stream, self.base, self.data, self.ended = stream, 0, b"", False

    def more(self) -> bool:
        got = b"" if self.ended else self.stream.read(max(STEP, len(self.data) // 2))
        self.ended = self.ended or not got
        self.data += got
        return bool(got)

    def has(self, at: int, n: int) -> bool:
        while at + n > self.base + len(self.data):
            if not self.more():
                return False
        return True

    def drop(self, at: int) -> None:
        self.data, self.base = self.data[at - self.base :], at

    def find(self, what: bytes, at: int) -> int:
        while True:
            found = self.data.find(what, at - self.base)
            if found >= 0:
                return found + self.base
            at = max(at, self.base + len(self.data) - len(what) + 1)
            if not self.more():
                return -1


def _inflate(window: _Window, at: int) -> tuple[bytes, int, str]:
    """Bytes of the gzip member at ``at``, the place after it, and what damage ended it."""
    z, out, place = zlib.decompressobj(31), [], at
    while not z.eof:
        if not window.has(place, 1):
            return b"".join(out), place, "short member"
        piece = window.data[place - window.base : place - window.base + STEP]
        try:
            out.append(z.decompress(piece))
        except zlib.error as why:
            return b"".join(out), place, f"member: {why}"
        place += len(piece) - len(z.unused_data)
    return b"".join(out), place, ""


def _plain(window: _Window, at: int) -> tuple[dict, int]:
    stop = window.find(END, at)
    if stop < 0:
        raise Damage("header without end")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", window.data[at - window.base : stop - window.base].replace(b"\r", b""))
    if not length:
        raise Damage("no content length")
    window.has(at, stop - at + 8 + int(length[1]))
    record, end = parse_record(window.data[at - window.base : stop - window.base + 8 + int(length[1])], 0)
    return record, at + end


def salvage(stream) -> Iterator[tuple[int, int, dict | str]]:
    """(begin, end, record or damage) of an archive, compressed by member, plain, or mixed.

    A record counts only if member checksum, lengths and digests hold.  After a failed check the reader looks for the
    next gzip magic or version line from which a whole record can be read; the bytes between are one quarantined
    gap.  Records that lie whole in the readable front of a broken member are kept, and the gap is logged too.
    """
    window, at, gap = _Window(stream), 0, None
    while window.has(at, 1):
        found: list[tuple[int, int, dict | str]] = []
        why, end = "", at
        head = window.has(at, 8) and window.data[at - window.base : at - window.base + 8]
        if head and head.startswith(MAGIC):
            data, end, why = _inflate(window, at)
            found = [(at, end, x) for _, _, x in _records_in(data)]
            if why:
                found = [x for x in found if isinstance(x[2], dict)]
        elif head and head.startswith(VERSION):
            try:
                record, end = _plain(window, at)
                found = [(at, end, record)]
            except Damage as damage:
                why = str(damage)
        else:
            why = "neither member nor version line"
        if found and not why and gap is not None and not any(isinstance(x[2], dict) for x in found):
            found, why = [], "member without a valid record"
        if why:
            if found:
                for x in found:
                    yield x
            gap = gap or (at, why)
            nexts = [x for x in (window.find(MAGIC, at + 1), window.find(VERSION, at + 1)) if x >= 0]
            if not nexts:
                while window.more():
                    window.drop(window.base + len(window.data))
                at = window.base + len(window.data)
                break
            at = min(nexts)
            window.drop(at)
            continue
        if gap is not None:
            yield gap[0], at, gap[1]
            gap = None
        yield from found
        at = end
        window.drop(at)
    if gap is not None:
        yield gap[0], at, gap[1]


def plan_records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): ``refers_to`` is null for responses.

    Of equal payloads of at least ``least`` bytes, the one with the largest page_id is the response.  Payloads are
    compared by SHA-256, and the groups are formed on digests alone, salted, so that no payload waits in a group; only
    payloads of revisits (and of few others, by a bitmap) are shuffled.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    long = F.octet_length("html") >= least
    keyed = rows.withColumn("key_", F.when(long, F.sha2("html", 256)))
    dealt = salted_group_value(keyed.select("page_id", "key_").filter("key_ is not null"), ["key_"], "page_id", F.max("page_id"))
    revisits = stored(dealt.filter("page_id < group_value").select("page_id", "key_", F.col("group_value").alias("refers_to")).distinct(), "revisits")
    met = may_hold(keyed, revisits, "page_id", "key_")
    columns = ["page_id", "url", "html", "refers_to"]
    out = met.filter("held__").join(revisits, ["page_id", "key_"], "left").select(*columns)
    return out.unionByName(met.filter("not held__").withColumn("refers_to", F.lit(None).cast(pages.schema["page_id"].dataType)).select(*columns))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``plan_records`` rows as .warc.gz files of about ``roll_bytes`` and returns their manifest (file, records).

    Every attempt of a task writes files of its own; only those in the manifest count, so lost tasks leave no trace
    in what is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, size, count, done = None, "", 0, 0, []
        store, base = storage(folder)
        store.create_dir(base, recursive=True)

        def close() -> None:
            out.close()
            done.append((f"{folder}/{path}", count))

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, url, html, refers = (x.as_py() for x in row)
                if out is None:
                    path, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                data = gzip_member(
                    make_record(
                        "response" if refers is None else "revisit",
                        None if page is None else f"urn:page:{page}",
                        url,
                        html.encode("utf-8", "surrogatepass"),
                        None if refers is None else f"urn:page:{refers}",
                    )
                )
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["file", "records"])

    return stored(records.mapInArrow(lean(write), "file string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``status`` record or gap) of the archives in column ``file``.

    A file is read by one task as a stream; memory is bounded by its largest record.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "end", "status", "reason", "record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        for batch in batches:
            for file in batch.column(batch.schema.get_field_index("file")).to_pylist():
                store, path = storage(file)
                with store.open_input_stream(path, compression=None) as stream:
                    for begin, end, got in salvage(stream):
                        if isinstance(got, str):
                            rows.append((file, begin, end, "gap", got, *[None] * 7))
                        else:
                            payload = got["payload"] if with_payload else None
                            size += len(payload or b"")
                            rows.append((file, begin, end, "record", None, *(got[k] for k in names[5:11]), payload))
                        if len(rows) >= 2000 or size >= 8 << 20:
                            yield flush()
                            rows, size = [], 0
        if rows:
            yield flush()

    files = manifest.select("file")
    n = max(1, min(10_000, manifest.count()))
    return files.repartition(n).mapInArrow(lean(read), RECORD_SCHEMA)


def whole(read: DataFrame, manifest: DataFrame) -> None:
    """Raises unless each file of ``manifest`` gave as many records as were written, and no gap."""
    found = read.groupBy("file").agg(F.count_if(F.col("status") == "record").alias("found"), F.count_if(F.col("status") == "gap").alias("gaps"))
    off = manifest.join(found, "file", "left").filter("found is null or found <> records or gaps > 0").limit(5).collect()
    if off:
        raise ValueError("archives are not whole: " + "; ".join(f"{r['file']} has {r['found'] or 0} of {r['records']} records and {r['gaps'] or 0} gaps" for r in off))


def archive_round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages written as WARC records, read back by the salvage reader, one row for each record read.

    What is read is counted against the manifest; a lost record or a gap is an error.  The archives are deleted in the end.
    """
    folder = work_dir(spark, "warc")
    records = plan_records(pages, least)
    manifest = write_archives(records, folder)
    read = stored(read_archives(manifest, with_payload=False), "warc-records")
    whole(read, manifest)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    discard(manifest)
    delete(spark, folder)
    return read.filter("status = 'record'").select(
        number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
