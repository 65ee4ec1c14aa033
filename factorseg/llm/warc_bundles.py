"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, with the seek table of the seekable format in a
skippable frame at its end: any Zstandard reader can read the whole file, and a reader that knows the table opens one frame.
The index maps a record's id to (file, frame, offset of the frame in the file, offset of the record in the opened frame).

Equal payloads (same SHA-1, xxHash and length) are stored once: the record of the smallest page_id is a response, the
others are revisits that refer to it and hold headers only. Payloads are hashed where they are read; what is shuffled to find
copies is a digest a page, and page texts move only if the table of repeated payloads is too large to be broadcast by its
written size (frequent ones are salted).

Files are written by tasks to the folder given (any that ``pyarrow.fs`` opens), under a name of their own; the index rows of the
task that succeeds name its files, so files left by a lost task are in no index and are never read. A task holds one
frame; a record larger than FRAME_BYTES is a frame of its own, and a file is closed at BUNDLE_BYTES.

Defined results: a null html is an empty payload; a null url is empty and odd characters in urls are percent-encoded (reversibly);
rows without a page_id are stored too, with an empty record id: a revisit if their payload has a page_id, else a response; rows that
repeat the smallest page_id of a payload are all responses; an empty table writes no file and gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from factorseg.llm.salting import join_summary
from factorseg.operators.lineage import Scratch, checkpoint_folder

FRAME_BYTES = 1 << 20      # of records in a frame, before compression
BUNDLE_BYTES = 256 << 20   # of a file
LEVEL = 3
# Fixed values of the seekable Zstandard format: marks of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
# Fixed values of WARC 1.1.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
PLACE = ("page_id long, record_type string, file string, frame int, frame_start long, frame_bytes long, record_start long, "
         "record_bytes long")
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: headers, an HTTP response as its block (without its payload, if a revisit), and the end mark."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{RECORD_URN}{'' if i is None else i}>"
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name(page_id), "WARC-Date": date,
            "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=~"), "WARC-Payload-Digest": f"sha1:{digest}"}
    if revisit:
        head |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": REVISIT_PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(data: memoryview, at: int) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name after the first line, and the place after the empty line."""
    end = bytes(data[at:at + 65536]).index(b"\r\n\r\n") + at
    lines = bytes(data[at:end]).decode().split("\r\n")[1:]
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}, end + 4


def parsed(frame: bytes) -> Iterator[tuple]:
    """The records of an opened frame in order, as RECORD; a response's payload is checked against its digest, and a revisit has
    none, its length is that of its HTTP header."""
    data, at = memoryview(frame), 0
    while at < len(data):
        if bytes(data[at:at + len(VERSION)]) != VERSION:
            raise ValueError(f"no WARC record at byte {at} of the frame")
        head, block = _headers(data, at)
        at = block + int(head["content-length"])
        http, payload_at = _headers(data, block)
        ident = lambda field: int(v) if (v := head[field][len(RECORD_URN) + 1:-1]) else None
        url, digest = unquote(head["warc-target-uri"]), head["warc-payload-digest"][len("sha1:"):]
        if head["warc-type"] == "revisit":
            yield ident("warc-record-id"), "revisit", ident("warc-refers-to"), url, int(http["content-length"]), digest, None
        else:
            payload = bytes(data[payload_at:at])
            if payload_digest(payload) != digest or len(payload) != int(http["content-length"]):
                raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
            yield ident("warc-record-id"), "response", None, url, len(payload), digest, payload
        at += 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, opened) sizes of all frames before it."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def _file_system(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def read_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, opened) of every frame of an open file, from its footer."""
    source.seek(size - 9)
    count, flags, mark = struct.unpack("<IBI", source.read(9))
    if mark != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    entry = 12 if flags & 128 else 8
    source.seek(size - 9 - entry * count)
    table, out, start = source.read(entry * count), [], 0
    for i in range(count):
        packed, opened = struct.unpack_from("<II", table, i * entry)
        out.append((start, packed, opened))
        start += packed
    return out


class _Bundles:
    """Frames and files of one task."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int):
        import zstandard
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.out, self.frames, self.held, self.places, self.size, self.written = None, [], [], [], 0, 0

    def add(self, page_id, kind: str, data: bytes):
        if self.held and self.size + len(data) > self.frame_bytes:
            yield from self.end_frame()
        self.places.append((page_id, kind, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def end_frame(self):
        if not self.held:
            return
        if self.out is None:
            system, path = _file_system(self.folder)
            system.create_dir(path, recursive=True)
            self.file = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            self.out = system.open_output_stream(_file_system(self.file)[1], compression=None)
        packed = self.squeeze.compress(b"".join(self.held))
        self.out.write(packed)
        for page_id, kind, start, length in self.places:
            yield page_id, kind, self.file, len(self.frames), self.written, len(packed), start, length
        self.frames.append((len(packed), self.size))
        self.written += len(packed)
        self.held, self.places, self.size = [], [], 0
        if self.written >= self.bundle_bytes:
            self.end_file()

    def end_file(self):
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out, self.frames, self.written = None, [], 0


def with_types(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to) of all pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        html.alias("html")).withColumns({"sha": F.unhex(F.sha1("html")), "xx": F.xxhash64("html"), "size": F.octet_length("html")})
    key = ["sha", "xx", "size"]
    repeated = scratch.cut(rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter("n > 1"))
    joined = join_summary(rows, repeated, key, "n", F.struct("page_id", "url"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", "sha", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write the archives under ``folder``/bundles and their index under ``folder``/index; returns the index (PLACE)."""
    spark = pages.sparkSession
    scratch = Scratch(spark)

    def write(batches):
        bundles = _Bundles(f"{folder}/bundles", frame_bytes, bundle_bytes, level)
        for batch in batches:
            rows = []
            for page_id, url, html, sha, kind, refers_to in zip(*[batch.column(c) for c in (
                    "page_id", "url", "html", "sha", "record_type", "refers_to")]):
                page_id, kind = page_id.as_py(), kind.as_py()
                digest = base64.b32encode(sha.as_py()).decode()
                data = record(page_id, url.as_py(), html.as_py(), digest, refers_to.as_py(), kind == "revisit", date)
                rows.extend(bundles.add(page_id, kind, data))
            if rows:
                yield _places(rows)
        rows = list(bundles.end_frame())
        bundles.end_file()
        if rows:
            yield _places(rows)

    with_types(pages, scratch).mapInArrow(write, PLACE).write.parquet(f"{folder}/index")
    scratch.drop()
    return spark.read.schema(PLACE).parquet(f"{folder}/index")


def _places(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PLACE.split(", ")])


def read_bundles(index: DataFrame) -> DataFrame:
    """RECORD of every record of the archives that an index names, read through the files' own seek tables."""
    files = index.select("file").distinct()

    def tables(batches):
        for batch in batches:
            rows = []
            for name in batch.column("file").to_pylist():
                system, path = _file_system(name)
                with system.open_input_file(path) as source:
                    rows += [(name, start, packed) for start, packed, _ in read_table(source, source.size())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "frame_start", "frame_bytes"])

    frames = files.mapInArrow(tables, "file string, frame_start long, frame_bytes long")
    return _opened(frames.repartition(F.xxhash64("file", "frame_start")), None)


def lookup(index: DataFrame, ids: DataFrame, id_col: str = "page_id") -> DataFrame:
    """RECORD of the records of some ids: only the frames that hold them are read."""
    wanted = index.join(ids.select(F.col(id_col).alias("page_id")).distinct(), "page_id", "left_semi")
    frames = wanted.groupBy("file", "frame_start", "frame_bytes").agg(F.sort_array(F.collect_list("record_start")).alias("starts"))
    return _opened(frames, "starts")


def _opened(frames: DataFrame, starts: str | None) -> DataFrame:
    def read(batches):
        import zstandard
        for batch in batches:
            chosen = batch.column(starts).to_pylist() if starts else [None] * batch.num_rows
            for name, start, packed, some in zip(*[batch.column(c).to_pylist() for c in ("file", "frame_start", "frame_bytes")], chosen):
                system, path = _file_system(name)
                with system.open_input_file(path) as source:
                    source.seek(start)
                    frame = zstandard.ZstdDecompressor().decompress(source.read(packed))
                rows = list(parsed(frame)) if some is None else [next(parsed(memoryview(frame)[s:])) for s in some]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORD.split(", ")])

    return frames.mapInArrow(read, RECORD)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/factorseg-warc-{uuid.uuid4().hex}"
