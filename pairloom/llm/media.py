"""Media columns: payloads in archives, and a data source that reads them by byte range.

Writing: each task stores its payloads as 8-bit grey PNG images (64 samples a row, deflated without loss) in
ZIP archives of bounded size, members stored as they are. An archive is written under a name of its own
attempt and renamed when whole, so that a task that runs again replaces what it wrote.

Reading: format("media_archive") plans one partition for each range of bytes of the archives in a directory.
A partition reads the archive's directory, takes the members whose headers begin in its range, fetches each by
its own offset, tries a member again on its own when it fails, and streams Arrow batches of bounded size. A
member that stays unreadable gives a row with the error, not a failed job; so does an archive whose directory
stays unreadable, one row by the partition of its first range.

Folders are opened through pyarrow.fs, so that any store with a URI that it knows can hold the archives.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairloom.llm.common import bounded_batches
from pairloom.session import scratch

ROW = 64
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 2 << 20
PNG_HEAD = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 appended up to a positive multiple of ROW."""
    return raw + bytes(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def to_png(raw: bytes) -> bytes:
    """The padded payload as a grey image, ROW samples a line, filter 0; a text chunk keeps the unpadded length."""
    samples = np.frombuffer(padded(raw), np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(samples), ROW + 1), np.uint8)
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of what to_png made; raises ValueError on anything damaged."""
    if media[:8] != PNG_HEAD:
        raise ValueError("no PNG header")
    at, packed, height, n = 8, [], 0, -1
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk at {at}")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, ROW + 1)
    return lines[:, 1:].tobytes(), n


def sample_features(payload: bytes) -> str:
    """Mean, variance, crossings of the mean, and energy of the first difference, of the 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    step, above = np.diff(x), x * n >= total
    return f"mean={total / n:.6f};var={(square - total * total / n) / n:.6f};cross={int((above[1:] != above[:-1]).sum())};step={int((step * step).sum())}"


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class _Archive:
    """One open archive under a temporary name."""

    def __init__(self, uri: str, name: str):
        self.store, self.folder = _folder(uri)
        self.name, self.temporary = f"{name}.zip", f"{self.folder}/_{name}-{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.bytes = self.members = 0

    def add(self, key: int | None, media: bytes) -> None:
        info = zipfile.ZipInfo(f"{self.members}/{'' if key is None else key}.png")
        self.zip.writestr(info, media)
        self.bytes += len(media)
        self.members += 1

    def close(self) -> None:
        self.zip.close()
        self.out.close()
        self.store.move(self.temporary, f"{self.folder}/{self.name}")


def _write(uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, archive, done = TaskContext.get().partitionId(), 0, None, []
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if archive is None:
                    archive = _Archive(uri, f"part-{part:06d}-{count:04d}")
                archive.add(key, to_png((text.as_py() or "").encode()))
                if archive.bytes >= ARCHIVE_BYTES:
                    archive.close()
                    done.append((archive.name, archive.members))
                    archive, count = None, count + 1
        if archive is not None:
            archive.close()
            done.append((archive.name, archive.members))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["archive", "members"])

    return run


def write_archives(docs: DataFrame, uri: str, text: str = "text", key: str = "doc_id") -> int:
    """Store every row's payload in archives under uri (a new folder); returns how many members were written."""
    bounded_batches(docs.sparkSession)
    store, folder = _folder(uri)
    store.create_dir(folder, recursive=True)
    own = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(_write(uri), "archive string, members long").agg(F.sum("members")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch = int(options.get("batchBytes", BATCH_BYTES))
        self.tries = int(options.get("tries", 3))
        self.with_media = options.get("media", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        store, folder = _folder(self.uri)
        files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.is_file and f.base_name.endswith(".zip"))
        return [ByteRange(p, a, a + self.range) for p, size in found for a in range(0, size, self.range)] or [ByteRange("", 0, 0)]

    def _fetch(self, store: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
        """One member's bytes by its own offset: the local header says where they begin."""
        with store.open_input_file(path) as f:
            f.seek(offset)
            head = f.read(30)
            if head[:4] != b"PK\3\4":
                raise ValueError("no member header")
            names, extra = struct.unpack_from("<HH", head, 26)
            f.seek(offset + 30 + names + extra)
            media = f.read(size)
        if len(media) != size:
            raise ValueError("member is cut short")
        return media

    def _tried(self, action) -> tuple:
        """(what the action gives, None), or (None, why the last of all tries failed)."""
        why = ""
        for attempt in range(self.tries):
            if attempt:
                time.sleep(0.05 * 2**attempt)
            try:
                return action(), None
            except (OSError, ValueError, zlib.error, struct.error, zipfile.BadZipFile) as e:
                why = f"{type(e).__name__}: {e}"
        return None, why

    def _member(self, store: fs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple:
        def read() -> tuple:
            media = self._fetch(store, path, info.header_offset, info.file_size)
            return media, *from_png(media)

        found, why = self._tried(read)
        return (*(found or (None, None, None)), why)

    @staticmethod
    def _directory(store: fs.FileSystem, path: str) -> list[zipfile.ZipInfo]:
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            return z.infolist()

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _folder(self.uri)
        listed, why = self._tried(lambda: self._directory(store, partition.path))
        if listed is None:
            if partition.start == 0:
                yield self._batch([(None, partition.path, None, None, None, None, None, None, None, why)])
            return
        members = [i for i in listed if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        for info in members:
            media, payload, n, error = self._member(store, partition.path, info)
            key = info.filename.rpartition("/")[2].removesuffix(".png")
            stored = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
            feature = None if payload is None else sample_features(payload)
            rows.append((int(key) if key else None, partition.path, info.header_offset, n, *stored, media if self.with_media else None, payload, feature, error))
            held += len(media or b"") + len(payload or b"")
            if held >= self.batch:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.name for f in MEMBER.fields])


MEMBER = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("media", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(uri); options rangeBytes, batchBytes, tries (of each member), and media
    (true: the stored bytes come along too, else null with their size and digest only)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> T.StructType:
        return MEMBER

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, uri: str, **options) -> DataFrame:
    """One row a member: key, archive, offset, n_bytes, media_bytes, media_sha256, media, payload, feature, error (null where the member was read)."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(uri)


def media_columns(docs: DataFrame, text: str = "text", key: str = "doc_id", uri: str | None = None, **options) -> DataFrame:
    """One row a document: what read_archives gives; read back from archives.

    A null or empty text is a payload of 64 bytes 0. Repeated rows are members of their own; a null doc_id
    stays null; an empty table gives no rows. Equal texts give equal media, payload and feature. Other columns
    are ignored. A member that cannot be read after all its tries has an error, and nulls for its contents. The
    archives stay in uri, or else in the shared folder until the driver ends.
    """
    spark = docs.sparkSession
    uri = uri or scratch(spark, "media")
    write_archives(docs, uri, text, key)
    return read_archives(spark, uri, **options)
