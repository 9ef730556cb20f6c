"""WARC archives: a writer with revisit records and a salvage reader.

Writer: each page is one record, its own gzip member; tasks roll archives of at most
``archive_bytes`` in the shared folder, each written under a new name and listed in
the result, so that a lost task leaves only unlisted files. Of records with equal
payloads (of at least ``min_bytes``) the one with the largest page_id is a response
and the others are revisits that refer to it. A null page_id sorts lowest; rows that
repeat the winning page_id are all responses.

Reader: members are read in order; each is checked (gzip CRC, version line, header,
length, payload digest). After a failed check the reader searches for the next gzip
magic, or version line in plain archives, that starts a valid record, goes on there,
and yields the bytes between as a quarantined gap. A truncated tail is a gap too.

A null html is an empty payload; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import checkpoint_dir, materialise, parts, small_batches

ARCHIVE_BYTES = 16 << 20
STEP = 4096
MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1."
RECORDS = "archive string, offset long, size long, kind string, reason string, target string, page_id string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, kind: str, size: int, digest: str, refers: str | None, payload: bytes) -> bytes:
    body = payload if kind == "response" else b""
    url = re.sub(r"[\r\n]", " ", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes, at: int = 0, most: int | None = None) -> tuple[dict, int]:
    """The record that starts at ``at`` and where it ends, its header of ``most`` bytes at most; ValueError says what is wrong."""
    if not data.startswith(VERSION, at):
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at, len(data) if most is None else at + most)
    if end < 0:
        raise ValueError("header does not end")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdecimal():
        raise ValueError("no content length")
    stop = end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end at its length")
    head["payload"] = data[end + 4 : stop]
    said = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and said.startswith("sha1:") and said[5:] != digest32(head["payload"]):
        raise ValueError("payload digest differs")
    return head, stop + 4


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, size, record or None, reason): records, and gaps where nothing valid starts."""
    at, bad, reason = 0, None, None

    def read(i: int) -> tuple[dict, int]:
        if data.startswith(MAGIC, i):
            z = zlib.decompressobj(31)
            parts, fed = [], i
            try:
                while not z.eof and fed < len(data):  # in steps: what follows the member is not copied
                    parts.append(z.decompress(data[fed : fed + STEP]))
                    fed += STEP
            except zlib.error as e:
                raise ValueError(f"gzip: {e}") from e
            if not z.eof:
                raise ValueError("gzip member is cut short")
            raw = b"".join(parts)
            head, end = parse(raw)
            if end != len(raw):
                raise ValueError("bytes after the record in its member")
            return head, min(fed, len(data)) - len(z.unused_data)
        return parse(data, i, 1 << 20)  # in plain archives nothing else bounds the search

    while at < len(data):
        try:
            head, end = read(at)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            marks = [x for x in (data.find(MAGIC, at + 1), data.find(VERSION, at + 1)) if x >= 0]
            at = min(marks, default=len(data))
            continue
        if bad is not None:
            yield bad, at - bad, None, reason
            bad = None
        yield at, end - at, head, None
        at = end
    if bad is not None:
        yield bad, len(data) - bad, None, reason


def _writer(folder: str, archive_bytes: int):
    def listed(name: str, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": [name], "records": pa.array([records], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0
        try:
            for batch in batches:
                for part in parts(batch, 100):  # members go to the stream as they come: a task holds few pages, not an archive
                    for page_id, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        member = pack(record(page_id or "", url or "", kind, len(payload), digest, refers, payload))
                        if out is not None and size + len(member) > archive_bytes:
                            out.close()
                            out = None
                            yield listed(name, records)
                        if out is None:
                            name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                            out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        out.write(member)
                        records += 1
                        size += len(member)
            if out is not None:
                out.close()
                out = None
                yield listed(name, records)
        finally:
            if out is not None:
                out.close()

    return run


def _reader(folder: str, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in RECORDS.split(", ")]
        schema = pa.schema([(x.split(" ")[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]]) for x in RECORDS.split(", ")])
        bare = lambda x: x[len("<urn:page:") : -1] if x and x.startswith("<urn:page:") else x
        for batch in batches:
            for archive, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{archive}", compression=None) as f:
                    data = f.read()
                out: list[tuple] = []
                weight = n_records = 0
                for offset, size, head, reason in salvage(data):
                    if head is None:
                        out.append((archive, offset, size, "gap", reason, *[None] * 5, data[offset : offset + size]))
                    else:
                        n_records += 1
                        revisit = head.get("warc-type") == "revisit"
                        n = int(head.get("x-payload-length", len(head["payload"]))) if revisit else len(head["payload"])
                        said = head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else digest32(head["payload"])
                        out.append((archive, offset, size, head.get("warc-type"), None, head.get("warc-target-uri"), bare(head.get("warc-record-id")), bare(head.get("warc-refers-to")), n, said, head["payload"]))
                    weight += len(out[-1][-1])
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], names=names)
                        out, weight = [], 0
                if whole and n_records != listed:
                    raise ValueError(f"{archive}: {n_records} records read, {listed} written")
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], names=names)

    return run


def write(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Folder of the archives and (archive, records), the archives that hold ``pages`` (page_id, url, html)."""
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/simplexa/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    slim = slim.withColumn("sha", F.sha1("payload"))
    first = slim.groupBy("sha").agg(F.max("page_id").alias("first"))
    both = slim.join(first, "sha")  # a hot payload's rows are split by the skew join: the winners' side has a row a payload
    again = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = both.select(
        F.col("page_id").cast("string"), "url", "payload", F.col("sha").alias("digest"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first").cast("string")).alias("refers")
    )
    with small_batches(pages.sparkSession, 500):
        return folder, materialise(out.mapInArrow(_hexed(_writer(folder, archive_bytes)), "archive string, records long"), "warc-list")


def _hexed(inner):
    """Base-32 form of the hexadecimal digests, before the writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turned() -> Iterator[pa.RecordBatch]:
            for b in batches:
                digest = pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(3).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], digest, *b.columns[4:]], names=b.schema.names)

        yield from inner(turned())

    return run


def read(folder: str, archives: DataFrame, whole: bool = False) -> DataFrame:
    """Records and gaps (kind "gap", with a reason and the quarantined bytes) of the listed archives; with ``whole``, fewer or more records than listed are an error."""
    return archives.select("archive", "records" if whole else F.lit(None).cast("long").alias("records")).repartition("archive").mapInArrow(_reader(folder, whole), RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from archives written of ``pages``."""
    folder, archives = write(pages, min_bytes)
    found = read(folder, archives, whole=True).where("kind != 'gap'")
    return found.select(F.expr("try_cast(page_id as long)").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.expr("try_cast(refers_to as long)").alias("refers_to"))
