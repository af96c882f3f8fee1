"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Readers get byte ranges, not files.  A task scans its range for the gzip magic, accepts a
candidate only if it decodes to a WARC header, and owns the records that start inside its range,
wherever they end.  Damage raises; it is never passed over.  Files are reached through ``pyarrow.fs``, so the folder may be any URI that
it opens (local or shared paths, HDFS, object stores).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import new_path, stash

MAGIC = b"\x1f\x8b\x08"
READ_BYTES = 1 << 18
SPLIT_BYTES = 8 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Records carry no capture time in the pages table; a fixed date keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit keeps the digest and length, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def decode_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of one record; the payload's digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} has a wrong length")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and headers.get("warc-payload-digest") != f"sha1:{digest(payload)}":
        raise ValueError(f"record {headers.get('warc-record-id')} has a wrong digest")
    return headers, payload


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: of equal payloads of at least ``min_bytes``, the largest page_id is kept.

    Equal means equal length and SHA-256 of the UTF-8 bytes; null html is an empty payload.
    Groups are reduced before the shuffle; html travels once, by page_id.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keys = base.select("page_id", F.sha2("html", 256).alias("sha"), F.octet_length("html").alias("octets")).filter(F.col("octets") >= min_bytes)
    heads = keys.groupBy("sha", "octets").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    heads = heads.select(F.col("sha").alias("head_sha"), F.col("octets").alias("head_octets"), "head")
    revisits = (
        keys.join(heads, (F.col("sha") == F.col("head_sha")) & (F.col("octets") == F.col("head_octets")) & (F.col("page_id") < F.col("head")))
        .select(F.col("page_id").alias("again"), F.col("sha").alias("again_sha"), "head")
        .distinct()
    )
    return base.join(revisits, (F.col("page_id") == F.col("again")) & (F.sha2("html", 256) == F.col("again_sha")), "left").select("page_id", "url", "html", F.col("head").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ``*.warc.gz``; returns the manifest (file, size, records).

    Each task writes a file of its own name and reports it in the manifest, which Spark commits
    once per partition: what a lost or repeated attempt wrote is in no manifest and never read.
    An empty table gives an empty manifest.
    """
    target = folder or new_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, records = None, f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
        system, path = _open(target)
        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                    data = encode_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                    if out is None:
                        system.create_dir(path, recursive=True)
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(data)
                    size, records = size + len(data), records + 1
        finally:
            if out is not None:
                out.close()
        if records:
            yield pa.RecordBatch.from_pydict({"file": [f"{target}/{name}"], "size": [size], "records": [records]})

    return stash(with_revisits(pages, min_bytes).mapInArrow(write, "file string, size long, records long"), "manifest")


class _Range:
    """The records of a file that start in [start, end).

    Only bytes that do not decode to a WARC header may be passed over, and only before the range's
    first record: a record that is damaged further on, or does not follow on the one before it,
    raises.  The last record's successor, which another range owns, must begin with a header too,
    and the file with a record; so no damaged header goes unnoticed between ranges.
    """

    def __init__(self, uri: str, start: int, end: int, size: int):
        system, path = _open(uri)
        self.file, self.at, self.end, self.size, self.buffer = system.open_input_file(path), start, end, size, bytearray()
        self.uri, self.strict = uri, start == 0

    def _more(self) -> bool:
        """Append to the buffer, which begins at ``self.at``."""
        to = self.at + len(self.buffer)
        data = self.file.read_at(min(READ_BYTES, self.size - to), to) if to < self.size else b""
        self.buffer += data
        return bool(data)

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.at += n

    def _decode(self, whole: bool = True) -> bytes | None:
        """The record at ``self.at``, or None if no WARC record starts there; moves past it.

        Without ``whole`` only its first bytes, and nothing moves.
        """
        machine, parts, used, start, probed = zlib.decompressobj(31), [], 0, self.at, False
        while not machine.eof:
            if used == len(self.buffer) and not self._more():
                if probed:
                    raise ValueError(f"{self.uri} has a record at {start} that is cut off")
                return None
            try:
                parts.append(machine.decompress(bytes(self.buffer[used:])))
            except zlib.error as broken:
                if probed:
                    raise ValueError(f"{self.uri} has a damaged record at {start}") from broken
                return None
            used = len(self.buffer)
            if not probed:
                begin = b"".join(parts)
                if len(begin) >= 7 or machine.eof:
                    if not begin.startswith(b"WARC/1."):
                        return None
                    if not whole:
                        return begin
                    probed = True
            if probed and not machine.eof:  # what is decoded need not be held
                self._drop(used)
                used = 0
        self._drop(used - len(machine.unused_data))
        return b"".join(parts)

    def __iter__(self) -> Iterator[bytes]:
        while self.at < self.end:
            while len(self.buffer) < len(MAGIC) and self._more():
                pass
            where = self.buffer.find(MAGIC)
            if where and self.strict:
                raise ValueError(f"{self.uri} has no record at {self.at}")
            if where < 0:
                if len(self.buffer) < len(MAGIC):
                    return
                self._drop(len(self.buffer) - len(MAGIC) + 1)
                if not self._more():
                    return
                continue
            self._drop(where)
            if self.at >= self.end:
                return
            data = self._decode()
            if data is None:
                if self.strict:
                    raise ValueError(f"{self.uri} has no record at {self.at}")
                self._drop(1)
            else:
                self.strict = True
                yield data
        if self.strict and self.at < self.size and self._decode(whole=False) is None:
            raise ValueError(f"{self.uri} has no record at {self.at}")

    def close(self) -> None:
        self.file.close()


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Every record of the manifest's files: page_id, url, record_type, refers_to, payload_bytes, payload_digest(, payload).

    Length and digest are those of the full payload, also for revisits; ``payload`` is null for them.
    """
    total = manifest.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("size > 0").select("file", "size", starts.alias("start")).repartition(max(1, min(10_000, -(-total // split_bytes))))
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * payloads]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for ranges in batches:
            frame = ranges.to_pydict()
            for uri, size, start in zip(frame["file"], frame["size"], frame["start"], strict=True):
                records, rows, held = _Range(uri, start, min(start + split_bytes, size), size), [], 0
                for data in records:
                    h, payload = decode_record(data)
                    page, refers = (int(h[k]) if k in h else None for k in ("x-page-id", "x-refers-to-page-id"))
                    revisit = h["warc-type"] == "revisit"
                    row = [page, h.get("warc-target-uri"), h["warc-type"], refers, int(h["x-payload-length"]) if revisit else len(payload), h["warc-payload-digest"].removeprefix("sha1:")]
                    rows.append(row + [None if revisit else payload] * payloads)
                    held += len(payload) * payloads + 100
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                records.close()
                if rows:
                    yield batch(rows)

    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    return splits.mapInArrow(read, kind)
