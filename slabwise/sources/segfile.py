"""Binary segment files: slabs on pages, then a metadata block with a checksummed footer at the end of the file.

Files are listed by Spark and opened where the work is, through Arrow's file systems (local, HDFS, object stores), so
that a reader seeks to what it needs and a segment may be larger than any buffer. A segment of up to PART_BYTES is one
file. The data of a longer one lies in part files, written side by side: part k has the blobs that begin in the k-th
PART_BYTES, at their place counted from there. Its .seg file then has metadata only, and is written last.
"""

from __future__ import annotations

import errno
import io
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from slabwise import config as C
from slabwise.tables import BATCH_BYTES, bounded_batches, drop
from slabwise.tables import file_system as hadoop_file_system

_RECORD = np.dtype([("hash", "<u8"), ("pos", "<i8"), ("logical_size", "<i8"), ("physical_size", "<i8"), ("flags", "<u8")])
_HEAD, _FOOT = "<qq", "<qIQ"
_PIECE = C.RECORD_BYTES << 16  # of metadata that is read at once
RECORD_DDL = "segment_id long, ctime long, hash long, pos long, logical_size long, physical_size long, flags long"
STATUS_DDL = "path string, status string, error string, segment_id long, ctime long, n long"


class SegmentError(ValueError):
    """A segment file that cannot be read."""


def encode_record(segment_id: int, ctime: int, records: np.ndarray) -> bytes:
    return struct.pack(_HEAD, segment_id, ctime) + np.asarray(records, _RECORD).tobytes()


def decode_record(raw: bytes) -> tuple[int, int, np.ndarray]:
    if len(raw) < C.HEADER_BYTES:
        raise SegmentError("too short for a segment header")
    if (len(raw) - C.HEADER_BYTES) % C.RECORD_BYTES:
        raise SegmentError(f"records do not fill multiples of {C.RECORD_BYTES} bytes")
    return (*struct.unpack_from(_HEAD, raw), np.frombuffer(raw, _RECORD, offset=C.HEADER_BYTES))


def encode_metadata(segment_id: int, ctime: int, records: np.ndarray) -> bytes:
    """The metadata block: record first, footer last, zeros between, whole pages."""
    body = encode_record(segment_id, ctime, records)
    size = -(-(len(body) + C.FOOTER_BYTES) // C.PAGE) * C.PAGE
    foot = struct.pack(_FOOT, len(body), zlib.crc32(body), C.SEGMENT_MAGIC)
    return body + bytes(size - len(body) - len(foot)) + foot


def decode_footer(raw: bytes) -> tuple[int, int]:
    """(length of the record, its CRC32)."""
    if len(raw) < C.FOOTER_BYTES:
        raise SegmentError("too short for a footer")
    length, crc, magic = struct.unpack_from(_FOOT, raw)
    if magic != C.SEGMENT_MAGIC:
        raise SegmentError("wrong magic")
    return length, crc


def metadata_place(f: io.BufferedIOBase | io.BytesIO, size: int) -> tuple[int, int, int]:
    """(start, length, CRC32) of the metadata of an open segment file, by its footer."""
    if size < C.FOOTER_BYTES:
        raise SegmentError("too short for a footer")
    f.seek(size - C.FOOTER_BYTES)
    length, crc = decode_footer(f.read(C.FOOTER_BYTES))
    start = size - -(-(length + C.FOOTER_BYTES) // C.PAGE) * C.PAGE
    if length < 0 or start < 0:
        raise SegmentError("metadata does not fit the file")
    return start, length, crc


def read_metadata(f: io.BufferedIOBase | io.BytesIO, size: int, segment_id: int | None = None) -> tuple[int, int, np.ndarray]:
    """(segment id, ctime, records) of an open segment file; checks magic, geometry, CRC and, if given, the id."""
    start, length, crc = metadata_place(f, size)
    f.seek(start)
    body = f.read(length)
    if zlib.crc32(body) != crc:
        raise SegmentError("checksum mismatch")
    out = decode_record(body)
    if segment_id is not None and out[0] != segment_id:
        raise SegmentError(f"segment id {out[0]} in a file named {segment_id}")
    return out


def file_system(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's file system of a URI (or an absolute local path), and the path in it."""
    scheme, _, rest = uri.partition(":")
    if not rest:
        return arrow_fs.LocalFileSystem(), uri
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return arrow_fs.FileSystem.from_uri(uri)


def id_of(name: str) -> int:
    m = re.match(r"[+-]?\d+", os.path.basename(name))
    return int(m[0]) if m else 0


def path_of(base: str, segment_id: int, shards: int) -> str:
    return f"{base}/segments/{segment_id % max(1, shards):04d}/{segment_id}.seg"


def part_of(base: str, segment_id: int, shards: int, part: int) -> str:
    return f"{path_of(base, segment_id, shards).removesuffix('.seg')}.{part:06d}.part"


def remove(spark: SparkSession, base: str, segment_id: int, shards: int) -> None:
    """Deletes a segment's files, first the one without which the others are not read."""
    path = path_of(base, segment_id, shards)
    drop(spark, path)
    fs, parts = hadoop_file_system(spark, f"{path.removesuffix('.seg')}.*.part")
    for s in fs.globStatus(parts) or []:
        fs.delete(s.getPath(), False)


def encode_segment(segment_id: int, ctime: int, slabs: list[list[tuple[int, bytes, int]]]) -> bytes:
    """A whole segment of slabs of (hash, value, flags); positions are absolute, slabs start on pages."""
    out = io.BytesIO()
    w = SegmentWriter(out, segment_id, ctime)
    for slab in slabs:
        for h, value, flags in slab:
            w.add(h, value, flags)
        w.end_slab()
    w.close()
    return out.getvalue()


class SegmentWriter:
    """Writes blobs one after another; of what is written only the records are kept, 40 bytes each."""

    def __init__(self, out, segment_id: int, ctime: int) -> None:
        self.out, self.segment_id, self.ctime = out, segment_id, ctime
        self.pos = 0
        self.records: list[tuple[int, int, int, int, int]] = []

    def add(self, h: int, value: bytes, flags: int) -> None:
        self.records.append((h & (1 << 64) - 1, self.pos, len(value), len(value), flags & (1 << 64) - 1))
        self.out.write(value)
        self.pos += len(value)

    def end_slab(self) -> None:
        pad = -self.pos % C.PAGE
        self.out.write(bytes(pad))
        self.pos += pad

    def close(self) -> int:
        """Size of the file."""
        self.end_slab()
        meta = encode_metadata(self.segment_id, self.ctime, np.array(self.records, _RECORD))
        self.out.write(meta)
        return self.pos + len(meta)


def write_segments(blobs: DataFrame, base: str, shards: int = 1, ctime: int = 0) -> DataFrame:
    """Writes (segment_id, slab, pos_order, hash, value, flags) rows as one file per segment under base/segments/;
    (segment_id, path, bytes) once read, which does the writing. base is a URI that all executors reach.

    A segment is streamed; a file appears whole under its name, and a task that runs again writes the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = slab = None

        def begin(seg: int):
            fs, to = file_system(path_of(base, seg, shards))
            fs.create_dir(os.path.dirname(to), recursive=True)
            tmp = f"{os.path.dirname(to)}/.{seg}.{os.getpid()}.tmp"
            return fs, tmp, to, SegmentWriter(fs.open_output_stream(tmp), seg, ctime)

        def end() -> pa.RecordBatch:
            fs, tmp, to, w = writer
            size = w.close()
            w.out.close()
            fs.move(tmp, to)
            return pa.RecordBatch.from_arrays([pa.array([w.segment_id]), pa.array([path_of(base, w.segment_id, shards)]), pa.array([size])], names=["segment_id", "path", "bytes"])

        for b in batches:
            for seg, sl, h, flags, value in zip(*(b.column(n).to_pylist() for n in ("segment_id", "slab", "hash", "flags", "value")), strict=True):
                if writer is None or seg != writer[3].segment_id:
                    if writer is not None:
                        yield end()
                    writer, slab = begin(seg), sl
                if sl != slab:
                    writer[3].end_slab()
                    slab = sl
                writer[3].add(h, value or b"", flags)
        if writer is not None:
            yield end()

    bounded_batches(blobs.sparkSession)
    order = ["segment_id", "slab", "pos_order"]
    rows = blobs.select(*order, "hash", "flags", "value").repartition("segment_id").sortWithinPartitions(*order)
    return rows.mapInArrow(run, "segment_id long, path string, bytes long")


def _zeros(out, n: int) -> None:
    for done in range(0, n, 1 << 20):
        out.write(bytes(min(1 << 20, n - done)))


class _Streamed:
    """A file that appears whole under its name: data in order of position, then a metadata block, or one of both."""

    def __init__(self, path: str, begins: int = 0) -> None:
        self.fs, self.to = file_system(path)
        at, name = os.path.split(self.to)
        self.fs.create_dir(at, recursive=True)
        self.tmp = f"{at}/.{name.removesuffix('.seg')}.{os.getpid()}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.pos, self.length, self.crc = begins, 0, 0

    def add(self, pos: int, value: bytes) -> None:
        if value:
            if pos < self.pos:
                raise SegmentError(f"blob at {pos} before {self.pos}")
            _zeros(self.out, pos - self.pos)
            self.out.write(value)
            self.pos = pos + len(value)

    def end_data(self) -> None:
        _zeros(self.out, -self.pos % C.PAGE)

    def add_metadata(self, raw: bytes) -> None:
        self.out.write(raw)
        self.length, self.crc = self.length + len(raw), zlib.crc32(raw, self.crc)

    def end_metadata(self) -> None:
        _zeros(self.out, -(self.length + C.FOOTER_BYTES) % C.PAGE)
        self.out.write(struct.pack(_FOOT, self.length, self.crc, C.SEGMENT_MAGIC))

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.to)


def _records_of(b: pa.RecordBatch) -> np.ndarray:
    out = np.empty(b.num_rows, _RECORD)
    for n in _RECORD.names:
        out[n] = b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False).view(_RECORD[n])
    return out


PLACED_DDL = "segment_id long, part long, hash long, pos long, logical_size long, physical_size long, flags long"


def write_placed(blobs: DataFrame, base: str, tasks: int, shards: int = 1, ctime: int = 0) -> DataFrame:
    """Writes (segment_id, part, task, pos, hash, flags, value) rows, one file for each segment and part; their records
    once read, which does the writing. Rows of a file have one ``task`` of as many as ``tasks``. Of segments with parts
    only these are written; ``write_metadata`` does the rest, from the records."""
    part_bytes = C.PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, records = None, None, []

        def end() -> None:
            if f is not None and now[1] is None:
                f.end_data()
                f.add_metadata(struct.pack(_HEAD, now[0], ctime))
                for r in records:
                    f.add_metadata(r.tobytes())
                f.end_metadata()
            if f is not None:
                f.close()

        for b in batches:
            if not b.num_rows:
                continue
            column = lambda n: b.column(b.schema.get_field_index(n))  # noqa: B023, E731
            size = pa.compute.fill_null(pa.compute.binary_length(column("value")), 0).cast("int64")
            own = pa.RecordBatch.from_arrays([*(column(n) for n in ("segment_id", "part", "hash", "pos")), size, size, column("flags")], names=["segment_id", "part", "hash", "pos", "logical_size", "physical_size", "flags"])
            each, first = _records_of(own), 0
            for i, (seg, part, pos, value) in enumerate(zip(*(column(n).to_pylist() for n in ("segment_id", "part", "pos", "value")), strict=True)):
                if (seg, part) != now:
                    records.append(each[first:i])
                    end()
                    now, records, first = (seg, part), [], i
                    f = _Streamed(path_of(base, seg, shards)) if part is None else _Streamed(part_of(base, seg, shards, part), part * part_bytes)
                f.add(pos, value or b"")
            if now[1] is None:
                records.append(each[first:])
            yield own
        end()

    bounded_batches(blobs.sparkSession)
    cols = ["segment_id", "part", "pos", "hash", "flags", "value", "task"]
    rows = blobs.select(*cols).repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("segment_id", "part", "pos", "hash")
    return rows.mapInArrow(run, PLACED_DDL)


def write_metadata(records: DataFrame, base: str, shards: int = 1, ctime: int = 0) -> DataFrame:
    """Writes the .seg files of segments whose parts are there; (segment_id, n) once read, which does the writing.
    Records are streamed, 40 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, n = None, None, 0

        def end() -> Iterator[pa.RecordBatch]:
            if f is not None:
                f.end_metadata()
                f.close()
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n])], names=["segment_id", "n"])

        for b in batches:
            each, of = _records_of(b), b.column(0).to_numpy()
            for own in np.split(each, np.flatnonzero(np.diff(of)) + 1):
                if not len(own):
                    continue
                if (seg := int(of[0])) != now:
                    yield from end()
                    now, n = seg, 0
                    f = _Streamed(path_of(base, now, shards))
                    f.add_metadata(struct.pack(_HEAD, now, ctime))
                f.add_metadata(own.tobytes())
                of, n = of[len(own) :], n + len(own)
        yield from end()

    bounded_batches(records.sparkSession)
    rows = records.select("segment_id", *_RECORD.names).repartition("segment_id").sortWithinPartitions("segment_id", "pos", "hash")
    return rows.mapInArrow(run, "segment_id long, n long")


def scan_files(spark: SparkSession, base: str) -> DataFrame:
    """(path, length) of the files *.seg under base, on any file system that Spark lists; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").option("recursiveFileLookup", "true").load(base).select("path", "length")


def _metadata_of(path: str) -> tuple[int, int, int, Iterator[np.ndarray]]:
    """(segment id, ctime, count, records) of a file by its footer. The checksum is made and the records are read by
    pieces, so that neither depends on their number for memory."""
    fs, at = file_system(path)
    try:
        with fs.open_input_file(at) as f:
            start, length, crc = metadata_place(f, f.size())
            made = 0
            for i in range(0, length, _PIECE):
                made = zlib.crc32(f.read_at(min(_PIECE, length - i), start + i), made)
            if made != crc:
                raise SegmentError("checksum mismatch")
            head = f.read_at(min(length, C.HEADER_BYTES), start)
    except FileNotFoundError as e:
        raise SegmentError(f"no such file: {e}") from None
    seg, ctime, _ = decode_record(head + bytes(max(0, length - C.HEADER_BYTES) % C.RECORD_BYTES))
    if seg != id_of(path):
        raise SegmentError(f"segment id {seg} in a file named {id_of(path)}")

    def read() -> Iterator[np.ndarray]:
        with fs.open_input_file(at) as f:
            for i in range(C.HEADER_BYTES, length, _PIECE):
                yield np.frombuffer(f.read_at(min(_PIECE, length - i), start + i), _RECORD)

    return seg, ctime, (length - C.HEADER_BYTES) // C.RECORD_BYTES, read()


def footers(files: DataFrame) -> DataFrame:
    """(path, status, error, segment_id, ctime, n): whether each file's metadata can be read; files stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    seg, ctime, n, _ = _metadata_of(path)
                    rows.append((path, "valid", None, seg, ctime, n))
                except SegmentError as e:
                    rows.append((path, "corrupt", str(e), None, None, 0))
            kinds = [pa.string()] * 3 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=["path", "status", "error", "segment_id", "ctime", "n"])

    return files.select("path").mapInArrow(run, STATUS_DDL)


def _record_batch(seg: int, ctime: int, r: np.ndarray) -> pa.RecordBatch:
    column = lambda c: np.ascontiguousarray(r[c]).view("<i8")
    fixed = [np.full(len(r), seg, np.int64), np.full(len(r), ctime, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*fixed, *map(column, _RECORD.names))], names=["segment_id", "ctime", *_RECORD.names])


def _record_batches(path: str) -> Iterator[pa.RecordBatch]:
    """The records of a file in batches, none of one that cannot be read."""
    try:
        seg, ctime, _, pieces = _metadata_of(path)
    except SegmentError:
        return
    for r in pieces:
        yield _record_batch(seg, ctime, r)


def records(files: DataFrame) -> DataFrame:
    """The blob records of all readable files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from _record_batches(path)

    return files.select("path").mapInArrow(run, RECORD_DDL)


def recovered_index(files: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """The index rebuilt from readable files: the newest segment's record of each hash, without ``tombstones``
    (column hash) and records marked deleted."""
    each = records(files).where(F.col("flags").bitwiseAND(F.lit(1 << C.DELETED_BIT)) == 0)
    cols = [c for c in each.columns if c != "hash"]
    newest = each.groupBy("hash").agg(F.max_by(F.struct(*cols), F.struct("segment_id", "pos")).alias("r")).select("hash", "r.*")
    return newest.join(tombstones, "hash", "left_anti") if tombstones is not None else newest


def read_range(entries: DataFrame, base: str, shards: int = 1, tasks: int | None = None) -> DataFrame:
    """entries (segment_id, pos, physical_size, …) with ``value``, the bytes of each blob, and ``error``, the name of
    what went wrong instead (null value). Entries are read in order from open files, by seeking; a long segment is dealt
    by its parts, to ``tasks`` tasks if given. A segment is there only if its .seg file is."""
    names = entries.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    part_bytes = C.PART_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, failed, parts = None, None, None, False
        part, g, lost = None, None, None

        def opened(path: str):
            fs, at = file_system(path)
            try:
                return fs.open_input_file(at), None
            except OSError as e:
                return None, _error_name(e)

        def read(seg: int, pos: int, size: int) -> tuple[bytes | None, str | None]:
            nonlocal now, f, failed, parts, part, g, lost
            if seg != now:
                for x in (f, g):
                    if x is not None:
                        x.close()
                now, part, g = seg, None, None
                f, failed = opened(path_of(base, seg, shards))
                parts = f is not None and _has_parts(f)
            if f is None:
                return None, failed
            if parts and size:
                if pos // part_bytes != part:
                    if g is not None:
                        g.close()
                    part = pos // part_bytes
                    g, lost = opened(part_of(base, seg, shards, part))
                if g is None:
                    return None, lost
            try:
                got = b"" if parts and not size else g.read_at(size, pos - part * part_bytes) if parts else f.read_at(size, pos)
            except OSError as e:
                return None, _error_name(e)
            return (got, None) if len(got) == size else (None, "EIO")

        for b in batches:
            for c in _slices(b):
                got = [read(*x) for x in zip(*(c.column(c.schema.get_field_index(n)).to_pylist() for n in ("segment_id", "pos", "physical_size")), strict=True)]
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array([v for v, _ in got], pa.binary()), pa.array([e for _, e in got], pa.string())], names=[*names, "value", "error"])
        for x in (f, g):
            if x is not None:
                x.close()

    bounded_batches(entries.sparkSession)
    near = ["segment_id", F.floor(F.col("pos") / part_bytes)]
    dealt = entries.repartition(tasks, *near) if tasks else entries.repartition(*near)
    return dealt.sortWithinPartitions("segment_id", "pos").mapInArrow(run, f"{kinds}, value binary, error string")


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of entries in slices whose blobs have BATCH_BYTES or so; a larger blob is a slice of its own."""
    first = held = 0
    for i, n in enumerate(b.column(b.schema.get_field_index("physical_size")).to_pylist()):
        if i > first and (held + n > BATCH_BYTES or i - first == 256):
            yield b.slice(first, i - first)
            first, held = i, 0
        held += n
    if b.num_rows > first:
        yield b.slice(first)


def _has_parts(f) -> bool:
    """Whether a segment's .seg file has metadata only."""
    try:
        return metadata_place(f, f.size())[0] == 0
    except (SegmentError, OSError):
        return False


def _error_name(e: OSError) -> str:
    return "ENOENT" if isinstance(e, FileNotFoundError) else errno.errorcode.get(e.errno or 0, "EIO")


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SegmentDataSource(DataSource):
    """``spark.read.format("slabwise_segments").load(path)``: blob records of a folder that all machines reach."""

    @classmethod
    def name(cls) -> str:
        return "slabwise_segments"

    def schema(self) -> str:
        return RECORD_DDL

    def reader(self, schema) -> DataSourceReader:
        return _SegmentReader(self.options["path"])


class _SegmentReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, at = file_system(self.path)
        prefix = self.path.removesuffix(at) if self.path.endswith(at) else ""
        found = fs.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True))
        return [_File(prefix + x.path) for x in sorted(found, key=lambda x: x.path) if x.path.endswith(".seg")] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        yield from _record_batches(partition.path)
