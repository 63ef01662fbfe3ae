"""Media columns through a Spark data source over archives.

Texts become 8-bit grey images (PNG, 64 samples a row) kept as stored members of archives (ZIP). Each writing task makes its own archives in
the shared folder and reports them; the list of reported archives is what counts, so files of failed or repeated
attempts are never read. The data source plans byte ranges over the archives, finds the members that begin in a range from the
archive's directory, and reads each member by its offset, anew up to `RETRIES` times if bytes or checksum fail. Batches of
about `BATCH_BYTES` go out as Arrow.

Defined cases: null or empty text: 64 zero samples; repeated rows and null ids are members of their own; an empty table gives no
members and no rows; equal texts give equal media, payload and feature.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import only, shared_dir, small_batches

WIDTH = 64
RETRIES = 3
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES = 256 << 20, 16 << 20, 8 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_image(data: bytes) -> bytes:
    """`data`, padded with zeros to a positive multiple of 64, as grey samples; its own length is a text entry."""
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    samples = np.zeros((size // WIDTH, WIDTH + 1), np.uint8)
    samples[:, 1:] = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, size // WIDTH, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[bytes, int]:
    """(samples, length of the data without padding)."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, size, width = 8, [], 0, WIDTH
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            size = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes(), size


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy in bits and mean step between neighbours, in thousandths."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = float(np.abs(np.diff(x.astype(np.int16))).mean()) if len(x) > 1 else 0.0
    values = {"mean": x.mean(), "sd": x.std(), "entropy": float(-(p * np.log2(p)).sum()), "step": step}
    return ";".join(f"{k}={round(float(v) * 1000)}" for k, v in values.items())


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_id(media: bytes, doc_id: object) -> bytes:
    """A member: the stored form, then the id's UTF-8 bytes and their number, -1 for null. Readers of images stop before them."""
    own = b"" if doc_id is None else str(doc_id).encode("utf-8", "surrogatepass")
    return media + own + struct.pack("<q", -1 if doc_id is None else len(own))


def without_id(member: bytes) -> tuple[bytes, str | None]:
    (n,) = struct.unpack("<q", member[-8:])
    return (member[:-8], None) if n < 0 else (member[: -8 - n], member[-8 - n : -8].decode("utf-8", "surrogatepass"))


def write_archives(docs: DataFrame, folder: str | None = None) -> str:
    """Store each text of `docs` (doc_id, text) as one member; returns the folder, which holds manifest.json."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, base = _open(folder)
        done, zipped, sink, name, members = [], None, None, "", 0

        def close() -> None:
            zipped.close()
            sink.close()
            done.append((name, to.get_file_info(f"{base}/{name}").size, members))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if zipped is None:
                    name, members = f"{uuid.uuid4().hex}.zip", 0
                    sink = to.open_output_stream(f"{base}/{name}", compression=None)
                    zipped = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                zipped.writestr(zipfile.ZipInfo(f"{members}.png"), with_id(encode_image((text.as_py() or "").encode()), doc_id.as_py()))
                members += 1
                if sink.tell() > ARCHIVE_BYTES:
                    close()
                    zipped = None
        if zipped is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["name", "bytes", "members"])

    # One row per archive, that is per task and ARCHIVE_BYTES.
    made = only(small_batches(docs), doc_id="doc_id", text="text").mapInArrow(run, "name string, bytes long, members long").collect()
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps([[r["name"], r["bytes"], r["members"]] for r in sorted(made)]).encode())
    return folder


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split

    def partitions(self) -> list[Range]:
        fs, path = _open(self.folder)
        with fs.open_input_stream(f"{path}/manifest.json") as file:
            archives = json.loads(file.read())
        return [Range(name, at, at + self.split) for name, size, members in archives if members for at in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, path = _open(self.folder)
        where = f"{path}/{partition.name}"
        with fs.open_input_file(where) as file, zipfile.ZipFile(file) as zipped:
            entries = [(i.header_offset, i.file_size, i.CRC) for i in zipped.infolist() if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        for offset, size, crc in entries:
            media, doc_id = without_id(read_member(fs, where, offset, size, crc))
            samples, n_bytes = decode_image(media)
            rows.append((doc_id, n_bytes, samples, media, feature(samples)))
            held += len(samples) + len(media)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def read_member(fs: pafs.FileSystem, path: str, offset: int, size: int, crc: int) -> bytes:
    """The bytes of one stored member, by the offset of its header; a failed read or checksum is tried anew from that offset."""
    for attempt in range(RETRIES):
        try:
            with fs.open_input_file(path) as file:
                head = file.read_at(30, offset)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member begins here")
                name, extra = struct.unpack("<HH", head[26:30])
                data = file.read_at(size, offset + 30 + name + extra)
            if len(data) != size or zlib.crc32(data) != crc:
                raise OSError("a member's checksum differs")
            return data
        except OSError:
            if attempt == RETRIES - 1:
                raise
    raise AssertionError


_FIELDS = pa.schema([("doc_id", pa.string()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("path", folder): doc_id string, n_bytes, payload (samples), media (stored bytes), feature."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id string, n_bytes long, payload binary, media binary, feature string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitbytes", SPLIT_BYTES)))


def media_columns(docs: DataFrame) -> DataFrame:
    """Write `docs` to archives and read them back through the data source; doc_id has the type it had."""
    spark = docs.sparkSession
    folder = write_archives(docs)
    spark.dataSource.register(MediaArchives)
    read = spark.read.format("media_archives").option("path", folder).load()
    return read.withColumn("doc_id", read["doc_id"].cast(docs.schema["doc_id"].dataType))
