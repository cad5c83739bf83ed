"""WARC archives: writing with revisits, and a salvage reader.

Writer. Each page is a record in a gzip member of its own, in an archive for each task. Of records with equal payloads
of at least `least` bytes the one with the largest id is the response, the others are revisits of it. Representatives
are found with partial maxima and joined on the digest, which Spark splits where one digest is hot.
Reader. A member that fails its checks (gzip checksum, record head, content length, payload digest) is not the end: the
reader searches for the next gzip member or version line that begins a valid record, goes on from there, and logs the
bytes between as a quarantined gap. It holds a record or a chunk of 1 MB, whichever is larger: a length that doesn't
fit, however large, is seen before the bytes are read, and a member is unpacked no further than its record goes. Such a
record costs its own bytes up to the next record that is whole. One of over 2 GB is a gap.

Defined results: null html is an empty payload; a null url is left out; equal ids make records each; a null id is the
id "null" and null again when read; an empty table makes no archives. Records carry WARC-Payload-Length, so that a
revisit tells its payload's size without its response.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import marked
from .shared import column, cut, filesystem, publish

VERSION = b"WARC/1.1"
LEAST = 1000
FILE_BYTES = 256 << 20
CHUNK = 1 << 20
#: Cells of a table hold no more; a larger record in a foreign archive is a gap.
MAX_RECORD = 1 << 31
NAME = 1 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "file string, offset long, kind string, page_id long, refers_to long, payload binary, payload_digest string, payload_bytes long, url string, gap_bytes long, reason string"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(value: str | None) -> int | None:
    text = (value or "").removeprefix("<urn:page:").rstrip(">")
    return int(text) if text.lstrip("-").isdigit() else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record as a gzip member of its own: a response, or with refers_to a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = b"" if refers_to is not None else payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload)), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(block))]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _archive(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        last = next(rows, None)
        while last is not None:
            name, about = f"{folder}/part-{part:05d}-{number:04d}.warc.gz", {}

            def fill(out) -> None:
                nonlocal last
                size = count = 0
                while last is not None and size < FILE_BYTES:
                    page, url, html, refers = last
                    out.write(raw := record(page, url, html, refers))
                    size, count = size + len(raw), count + 1
                    last = next(rows, None)
                about.update(bytes=size, records=count)

            publish(name, fill)
            number += 1
            yield pa.record_batch({"path": [name], "records": pa.array([about["records"]], pa.int64()), "bytes": pa.array([about["bytes"]], pa.int64())})

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages as archives below `folder`; returns (path, records, bytes) of each."""
    payload = F.coalesce(column(pages, html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).cast("string").alias("url"), payload.alias("html"))
    digest = rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.length("html").alias("size")).where(F.col("size") >= least)
    first = digest.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = cut(first, "digests")
    keyed = rows.withColumn("digest", F.when(F.length("html") >= least, F.unhex(F.sha1("html"))))
    # pages whose digest isn't among the repeated ones (told by a bitmap of bounded size) are never shuffled
    keyed = marked(keyed, first.select("digest"))
    single = keyed.where(~F.col("open")).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    joined = keyed.where("open").join(first, "digest", "left")
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first")).when(F.col("page_id").isNull(), F.col("first"))
    joined = joined.select("page_id", "url", "html", refers.alias("refers_to"))
    return cut(single.unionByName(joined).mapInArrow(_archive(folder), "path string, records long, bytes long"), "archives")


class _Source:
    """Bytes of a file by place. What is held is the last piece that was asked for, or a chunk; `most` is the largest."""

    def __init__(self, stream):
        stream.seek(0, 2)
        self.stream, self.size, self.data, self.start, self.most = stream, stream.tell(), b"", 0, 0

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.start or at + n > self.start + len(self.data):
            self.data = b""
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(min(max(CHUNK, n), self.size - at))
            self.most = max(self.most, len(self.data))
        return self.data[at - self.start : at - self.start + n]

    def find(self, at: int) -> int | None:
        """The next place of a gzip member or a version line."""
        while len(block := self.read(at, CHUNK)) >= 4:
            found = [k for k in (block.find(b"\x1f\x8b\x08"), block.find(b"WARC/1.")) if k >= 0]
            if found:
                return at + min(found)
            at += len(block) - 6 if len(block) == CHUNK else len(block)
        return None


def _head(raw: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, start of the block, its length) of a record at the start of `raw`; None if more bytes may hold the end of
    the head, ValueError if they can't."""
    if not raw.startswith(b"WARC/1."):
        raise ValueError("no version line")
    stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        # a field's name is short, its value may be long
        if raw.find(b"\r\n", 0, NAME) < 0 <= len(raw) - NAME or any(b":" not in x[:NAME] for x in raw.split(b"\r\n")[1:] if len(x) >= NAME):
            raise ValueError("damaged head")
        return None
    fields = {}
    for line in raw[:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("damaged head")
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise ValueError("damaged head")
    return fields, stop + 4, int(fields["content-length"])


def _checked(fields: dict[str, str], block: bytes) -> bytes:
    if fields["warc-type"] == "response" and (want := fields.get("warc-payload-digest", "")).startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != want[5:]:
            raise ValueError("payload digest doesn't fit")
    return block


def _at(source: _Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at a place, gzipped or plain, and where it ends. No more is held than the head, and as many bytes as it
    claims where these end as a record does: a wrong length is seen before its block is read."""
    if source.read(at, 3) == b"\x1f\x8b\x08":
        return _member(source, at)
    have = 1 << 16
    while (head := _head(raw := source.read(at, have))) is None:
        if len(raw) < have or have > MAX_RECORD:
            raise ValueError("head without an end")
        have *= 2
    fields, start, size = head
    if source.read(at + start + size, 4) != b"\r\n\r\n":
        raise ValueError("content length doesn't fit")
    if size > MAX_RECORD:
        raise ValueError("record too large")
    block = source.read(at + start, size)
    return fields, _checked(fields, block), at + start + size + 4


def _member(source: _Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """As _at, of a gzip member, which is unpacked in pieces and no further than its record goes."""
    unpack, out, place, head = zlib.decompressobj(31), bytearray(), at, None
    while not unpack.eof:
        packed = unpack.unconsumed_tail or source.read(place, 64 << 10)
        if not packed:
            raise ValueError("member without an end")
        place += 0 if unpack.unconsumed_tail else len(packed)
        try:
            out += unpack.decompress(packed, 256 << 10)
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        if head is None:
            head = _head(bytes(out))
        if head and len(out) > head[1] + head[2] + 4:
            raise ValueError("bytes after the record in its member")
        if len(out) > MAX_RECORD:
            raise ValueError("record too large")
        source.most = max(source.most, len(out))
    if head is None:
        raise ValueError("head without an end")
    fields, start, size = head
    if len(out) < start + size + 4 or out[start + size :] != b"\r\n\r\n":
        raise ValueError("content length doesn't fit")
    del out[start + size :]
    del out[:start]
    return fields, _checked(fields, bytes(out)), place - len(unpack.unused_data)


def salvage(stream) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """(kind, place, end, fields or reason, block): kind is "record", or "gap" for quarantined bytes. The stream can seek."""
    source, at = _Source(stream), 0
    while at < source.size:
        try:
            fields, block, end = _at(source, at)
        except ValueError as e:
            bad, reason, place = at, str(e), at + 1
            while (found := source.find(place)) is not None:
                try:
                    _at(source, found)
                    break
                except ValueError:
                    place = found + 1
            at = source.size if found is None else found
            yield "gap", bad, at, {"reason": reason}, b""
            continue
        yield "record", at, end, fields, block
        at = end


def _rows(name: str, stream) -> Iterator[tuple]:
    for kind, at, end, fields, block in salvage(stream):
        if kind == "gap":
            yield name, at, "gap", None, None, None, None, None, None, end - at, fields["reason"]
            continue
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        sha1 = base64.b32decode(digest).hex() if len(digest) == 32 else hashlib.sha1(block).hexdigest()
        size = int(fields.get("warc-payload-length", len(block))) if fields["warc-type"] == "revisit" else len(block)
        refers = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
        yield name, at, fields["warc-type"], _page(fields.get("warc-record-id")), refers, block, sha1, size, fields.get("warc-target-uri"), None, None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in RECORDS.split(", ")]
    for batch in batches:
        for name in batch.column(0).to_pylist():
            fs, at = filesystem(name)
            with fs.open_input_file(at) as stream:
                rows, held = [], 0
                for row in _rows(name, stream):
                    rows.append(row)
                    held += len(row[5] or b"") + len(row[8] or "") + 200
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def read(archives: DataFrame) -> DataFrame:
    """The records and gaps (columns: RECORDS) of archives (column path); a task reads whole archives."""
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(_read, RECORDS)


def read_bytes(raw: bytes) -> list[tuple]:
    """The rows of an archive in memory."""
    return list(_rows("memory", io.BytesIO(raw)))
