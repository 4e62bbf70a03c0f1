"""Line dedup over range-partitioned line hashes.

Each line becomes two 64-bit hashes of its key with document and position. These are range-partitioned by (hash,
document), so a line that holds a third of all rows is dealt over many tasks, and sorted by document and position
within. One pass streams the runs of equal hashes, emits what to drop, and returns small per-partition notes for the
two runs that may go on in a neighbour. What travels back is a compressed keep bitmap for each document, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import BLANKS, bounded_batches, lower_ascii, release, written

#: Bytes of bitmaps that are broadcast to the scan, at most; with more, the texts are shuffled to them.
BROADCAST_BYTES = 32 << 20
_NO_ID = -(2**63)
_MARK, _OPEN, _NOTE = 0, 1, 2
_OUT = "kind int, h1 long, h2 long, id long, ver long, pos int, n long"
_SCHEMA = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("ver", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doc(id_col: str, text_col: str) -> list[Column]:
    """A document is told by its id and a hash of its text, so rows that repeat an id keep their own bitmaps."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("ver")]


class _Run:
    """A run of equal hashes that may go on in the next batch."""

    def __init__(self, key: tuple[int, int], first: tuple[int, int, int], edge: bool) -> None:
        self.key, self.first, self.edge, self.docs, self.last, self.rows = key, first, edge, 0, None, []


def _stream(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    run: _Run | None = None
    seen = False

    def emit(kind: int, key, rows: np.ndarray, n=0) -> pa.RecordBatch:
        k = len(rows)
        h1, h2 = (np.full(k, x, np.int64) if np.isscalar(x) else x for x in key)
        cols = [np.full(k, kind, np.int32), h1, h2, rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int32), np.full(k, n, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_SCHEMA)

    def grow(r: _Run, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = rows[:, 0]
        r.docs += int((np.diff(ids) != 0).sum()) + int(r.last is None or ids[0] != r.last)
        r.last = ids[-1]
        r.rows.append(rows)
        if r.docs >= min_docs:  # known to be frequent: nothing has to be kept
            yield emit(_MARK, r.key, np.concatenate(r.rows))
            r.rows = []

    def close(r: _Run, edge: bool) -> Iterator[pa.RecordBatch]:
        first = np.array([r.first], np.int64)
        if edge or r.edge:
            yield emit(_NOTE, r.key, first, r.docs)
            if r.rows:
                yield emit(_OPEN, r.key, np.concatenate(r.rows))
        elif r.docs >= min_docs and keep_first:
            yield emit(_NOTE, r.key, first, r.docs)

    for b in batches:
        if not b.num_rows:
            continue
        h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        rows = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy().astype(np.int64)], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(h1) != 0) | (np.diff(h2) != 0))))
        stops = np.append(starts[1:], len(h1))
        lo = 0
        if run and run.key == (h1[0], h2[0]):
            yield from grow(run, rows[: stops[0]])
            lo = 1
        if lo < len(starts):
            if run:
                yield from close(run, False)
            if lo < len(starts) - 1:  # runs that begin and end here
                a, z = starts[lo], starts[-1]
                new_doc = np.concatenate(([1], (np.diff(rows[a:z, 0]) != 0).astype(np.int64)))
                new_doc[starts[lo:-1] - a] = 1
                docs = np.add.reduceat(new_doc, starts[lo:-1] - a)
                if not seen:  # the partition's first run
                    run = _Run((int(h1[a]), int(h2[a])), tuple(rows[a]), True)
                    yield from grow(run, rows[a : stops[lo]])
                    yield from close(run, False)
                    docs[0] = 0
                hot = docs >= min_docs
                if hot.any():
                    keep = np.repeat(hot, stops[lo:-1] - starts[lo:-1])
                    yield emit(_MARK, (h1[a:z][keep], h2[a:z][keep]), rows[a:z][keep])
                    if keep_first:
                        at = starts[lo:-1][hot]
                        yield emit(_NOTE, (h1[at], h2[at]), rows[at], min_docs)
                seen = True
            a = starts[-1]
            run = _Run((int(h1[a]), int(h2[a])), tuple(rows[a]), not seen)
            yield from grow(run, rows[a:])
        seen = True
    if run:
        yield from close(run, True)


def line_marks(docs: DataFrame, min_docs: int = 10, *, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ver, pos) of every line to drop: its key has ``min_chars`` code points or more and is in ``min_docs``
    documents or more; with ``keep_first`` the first of its lines stays."""
    spark = docs.sparkSession
    key = F.transform(_lines(F.col(text_col)), lambda x: lower_ascii(F.btrim(x, F.lit(BLANKS))))
    hashed = F.transform(key, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), (F.length(x) >= min_chars).alias("long")))
    each = docs.select(*_doc(id_col, text_col), F.posexplode(hashed).alias("pos", "x")).where("x.long").select("x.h1", "x.h2", "id", "ver", "pos")
    order = ["h1", "h2", "id", "ver", "pos"]
    bounded_batches(spark)
    each = written(each, "lines")  # splitting and hashing once, not once more for the bounds of the ranges
    out = written(each.repartitionByRange("h1", "h2", "id").sortWithinPartitions(*order).mapInArrow(lambda b: _stream(b, min_docs, keep_first), _OUT), "line-marks")
    release(each)
    notes = out.where(F.col("kind") == _NOTE).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min(F.struct("id", "ver", "pos")).alias("first"))
    frequent = notes.where(F.col("docs") >= min_docs)
    marks = out.where(F.col("kind") == _MARK).select("id", "ver", "pos")
    marks = marks.unionByName(out.where(F.col("kind") == _OPEN).join(frequent, ["h1", "h2"], "left_semi").select("id", "ver", "pos"))
    if keep_first:
        marks = marks.join(frequent.select("first.*"), ["id", "ver", "pos"], "left_anti")
    return marks


def keep_bitmaps(marks: DataFrame) -> DataFrame:
    """(id, ver, keep): for each document with lines to drop, a deflated bitmap, 1 for a line that stays; lines past
    its end stay."""
    grouped = marks.groupBy("id", "ver").agg(F.collect_set("pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for at in b.column(2):
                at = np.asarray(at.values)
                bits = np.ones(int(at.max()) + 1, np.uint8)
                bits[at] = 0
                maps.append(zlib.compress(len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["id", "ver", "keep"])

    return grouped.mapInArrow(run, "id long, ver long, keep binary")


def kept_lines(text: str, keep: bytes | None) -> tuple[int, int, str]:
    """(lines, dropped, text that stays)."""
    if keep is None:
        return text.count("\n") + 1, 0, text
    lines, raw = text.split("\n"), zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), count=int.from_bytes(raw[:4], "little"))
    stay = [x for x, b in zip(lines, bits.tolist(), strict=False) if b] + lines[len(bits) :]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def dedup_lines(docs: DataFrame, min_docs: int = 10, *, keep_first: bool = False, min_chars: int = 1, counts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that stay in ``text_col``, and, with ``counts``, new columns n_lines and n_dropped.

    A line's key is the line without outer ASCII blanks, A-Z in lower case. Null and empty texts are one empty line.
    Rows that share an id are one document when documents are counted, a null id too; each keeps its own bitmap.
    With ``counts``, columns named n_lines or n_dropped in the input are replaced; all others pass through. An empty
    table gives no rows.
    """
    marks = line_marks(docs, min_docs, keep_first=keep_first, min_chars=min_chars, id_col=id_col, text_col=text_col)
    maps = written(keep_bitmaps(marks), "bitmaps")
    if (maps.agg(F.sum(F.octet_length("keep") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        maps = F.broadcast(maps)
    more = ["n_lines", "n_dropped"] if counts else []
    names = [c for c in docs.columns if c not in more]
    left = docs.select(F.struct(*names).alias("row"), *_doc(id_col, text_col))
    both = left.join(maps, ["id", "ver"], "left").select("row", "keep")
    at = next(i for i, c in enumerate(names) if c == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            done = [kept_lines(t or "", k) for t, k in zip(fields[at].to_pylist(), b.column(1).to_pylist(), strict=True)]
            fields[at] = pa.array([x[2] for x in done], pa.string())
            yield pa.RecordBatch.from_arrays([*fields, *(pa.array([x[i] for x in done], pa.int64()) for i in range(len(more)))], names=[*names, *more])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return both.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names] + [f"{c} long" for c in more]))


def digest(done: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return done.select(id_col, "n_lines", "n_dropped", F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"))
