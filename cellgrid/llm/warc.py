"""Dictionary-compressed WARC archives.

Each archive is a .warc.zst file: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary
built from records of the archive, itself compressed, and then one Zstandard frame per WARC record, so that a
reader can seek to any record. Records with equal payloads are written once as ``response``; the others are
``revisit`` records of the identical-payload-digest profile that refer to it and keep its HTTP head, hence its length.

The first page of each payload is found by a min() over digests that is combined before the shuffle; only the pages
that revisit another are joined back, by page id and digest, so a payload with very many copies is spread over all tasks and
where nothing is repeated no page is shuffled. Each task writes the pages it has to archives of ``ARCHIVE_RECORDS`` records, and keeps
``SAMPLE_BYTES`` of records for the dictionary and then one record at a time: a record that arrives while
the sample fills is kept with it and written first. The dictionary is trained on this documented, bounded sample.

A task writes to a name of its own and renames it at the end, so a repeated or speculative attempt replaces
the archive by an equal one; an attempt that fails deletes what it began (one whose executor is lost leaves a
``.<hex>`` file, which no reader looks at). Archives go to the shared folder of the cluster by the file system that its
address names (pyarrow.fs); the table of archives that write_archives returns is itself kept there.

Defined results: null html is an empty payload; payloads shorter than ``min_bytes`` are responses always; of equal
payloads every row with the smallest page id is a response, so rows that repeat page id and html are responses alike;
null page ids are written with an empty id, never first unless no other has the payload; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

ARCHIVE_RECORDS = 4000
SAMPLE_BYTES = 4 << 20
DICT_BYTES = 64 << 10
LEVEL = 6
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record(page_id, url, payload: bytes, first) -> bytes:
    """A WARC/1.1 record; first: the page whose equal payload this one revisits, or None."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    uri = "".join(c if 32 < ord(c) < 127 else f"%{ord(c):02X}" for c in (url or "urn:none"))
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says of its page; a response's length and digest are taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][10:-1]
    out = {"page_id": int(page) if page else None, "record_type": fields["WARC-Type"], "refers_to": None}
    if fields["WARC-Type"] == "revisit":
        length = next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
        return out | {"payload_bytes": int(length[16:]), "payload_digest": fields["WARC-Payload-Digest"][5:], "refers_to": int(fields["WARC-Refers-To"][10:-1])}
    return out | {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}


def train(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None where they are too few for one."""
    if len(sample) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=1024, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Collects a sample, then builds the dictionary and streams frames."""

    def __init__(self, out):
        self.out, self.sample, self.held, self.frames = out, [], 0, None

    def add(self, raw: bytes) -> None:
        if self.frames is None:
            self.sample.append(raw)
            self.held += len(raw)
            if self.held >= SAMPLE_BYTES:
                self._begin()
        else:
            self.out.write(self.frames.compress(raw))

    def _begin(self) -> None:
        made = train(self.sample)
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=made) if made else zstandard.ZstdCompressor(level=LEVEL)
        body = zstandard.ZstdCompressor(level=LEVEL).compress(made.as_bytes()) if made else b""
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        for raw in self.sample:
            self.out.write(self.frames.compress(raw))
        self.sample = []

    def close(self) -> None:
        if self.frames is None:
            self._begin()


def records(file) -> Iterator[bytes]:
    """Every record of an archive, one at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    assert magic == SKIPPABLE, "not a dictionary-compressed archive"
    body = file.read(size)
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body)) if body else None
    frames = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    left = b""
    while True:
        if not left:
            left = file.read(1 << 20)
            if not left:
                return
        one = frames.decompressobj()
        out = io.BytesIO()
        while not one.eof:
            if not left:
                left = file.read(1 << 20)
                if not left:
                    raise EOFError("the archive ends inside a record")
            out.write(one.decompress(left))
            left = one.unused_data if one.eof else b""
        yield out.getvalue()


def open_fs(address: str):
    from pyarrow import fs

    if "://" not in address and not address.startswith("file:"):
        return fs.LocalFileSystem(), address
    return fs.FileSystem.from_uri("file://" + address[5:] if address.startswith("file:/") and not address.startswith("file://") else address)


def _write(folder: str):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = open_fs(folder)
        system.create_dir(where, recursive=True)
        task = TaskContext.get().partitionId()
        writer, file, temp = None, None, ""
        made: list[list] = []

        def finish() -> None:
            writer.close()
            file.close()
            try:
                system.move(temp, f"{where}/{made[-1][0]}")
            except OSError:  # an earlier attempt has put the same archive there
                system.delete_file(temp)

        def told(batch: pa.RecordBatch) -> None:
            nonlocal writer, file, temp
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                if not made or made[-1][1] == ARCHIVE_RECORDS:
                    if made:
                        finish()
                    made.append([f"part-{task:06d}-{len(made):03d}.warc.zst", 0])
                    temp = f"{where}/.{uuid.uuid4().hex}"
                    file = system.open_output_stream(temp, compression=None)
                    writer = Writer(file)
                writer.add(record(page, url, (html or "").encode("utf-8", "surrogatepass"), first))
                made[-1][1] += 1

        try:
            for batch in batches:
                told(batch)
            if made:
                finish()
        except BaseException:  # the attempt that follows writes all anew; what this one began is no archive
            if file is not None:
                with contextlib.suppress(Exception):
                    file.close()
                with contextlib.suppress(Exception):
                    system.delete_file(temp)
            raise
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["name", "records"])

    return part


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write archives of all pages (page_id, url, html); returns the table (folder, name, records) of archives."""
    folder = folder or new_path(pages.sparkSession, "warc")
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body.cast("binary")).alias("digest"))
    known = materialise(rows.select("page_id", "digest", F.octet_length(body).alias("bytes")), "digests")
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND first IS NOT NULL").select("digest", "first")
    again = known.where(F.col("bytes") >= min_bytes).join(firsts, "digest").where("page_id IS NULL OR page_id <> first")
    again = materialise(again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct(), "revisits")
    same = F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest"))
    told = rows.join(again, same, "left").select("page_id", "url", "html", "first").sortWithinPartitions("page_id")
    made = told.mapInArrow(_write(folder), "name string, records long")
    return materialise(made.select(F.lit(folder).alias("folder"), "name", "records"), "archives")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    for batch in batches:
        for folder, name in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist()):
            system, where = open_fs(folder)
            rows = []
            with system.open_input_stream(f"{where}/{name}", compression=None) as file:
                for raw in records(file):
                    rows.append(parse(raw))
                    if len(rows) == 5000:
                        yield out(rows)
                        rows = []
            yield out(rows)


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One row per record of the archives."""
    n = max(1, archives.count())
    return archives.select("folder", "name").repartition(n).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
