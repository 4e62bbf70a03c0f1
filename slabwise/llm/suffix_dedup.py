"""Removal of long repeated byte strings with run-length indexes.

Every window of ``length`` bytes is assigned to one anchor inside it, its smallest hashed k-gram, which the window's
bytes alone decide: equal windows have equal anchors, so texts are sharded by anchor. The windows of one anchor are a
segment of the text. Segments that are equal from end to end are one string with many places, of which the first
stands for all. Distinct segments of an anchor meet in one task: the first of each is indexed (a run-compressed
Burrows-Wheeler transform with sampled run ends), the others stream through it, and their windows with matching
statistics of ``length`` or more are marked; what did not match is the input of the next round. Anchors with too many
distinct segments are cut finer, again and again, until they fit or are single windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import bounded_batches, release, written
from slabwise.llm.runindex import RunLengthIndex

#: Bytes of a k-gram (three 8-byte words).
GRAM = 24
#: Bytes of segments that meet in one index and its streams, about.
BLOCK = 1 << 20
#: Distinct segments of an anchor that meet in one task, at most; those of more crowded anchors are cut finer.
CROWD = 16
#: Windows in a cut, coarse to fine. Single windows of one anchor are equal, so that nothing stays crowded.
WIDTHS = (20, 5, 1)
#: Bytes of text whose k-grams are hashed at once; longer texts are cut with an overlap that loses no window.
SLICE = 1 << 20
_POS_BITS = 28
_NO_ID = -(2**63)
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_BASE = 0xA24BAED4963EE407
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on."""
    n = len(b) - GRAM + 1
    padded = np.concatenate([b, np.zeros(16, np.uint8)])
    word = np.empty(n + 16, np.uint64)
    for o in range(8):
        k = len(word[o::8])
        word[o::8] = padded[o : o + 8 * k].view("<u8") if len(padded) >= o + 8 * k else np.append(padded[o:], np.zeros(o + 8 * k - len(padded), np.uint8)).view("<u8")
    h = word[:n] * _M1
    h ^= h >> np.uint64(32)
    h += word[8 : n + 8] * _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h += word[16 : n + 16] * _M4
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        each = [np.full(max(n, SLICE + 4096), b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in each:
            x[0] = 1
        _powers = (np.cumprod(each[0]), np.cumprod(each[1]))
    return _powers[0][:n], _powers[1][:n]


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text number, first window start, number of windows, anchor's offset, anchor hash, segment hash) of each run
    of windows with one anchor."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if not len(sizes) or sizes.max() < length:
        return none
    b = np.frombuffer(b"".join(texts), np.uint8)
    h = _gram_hashes(b)
    low = np.uint64((1 << _POS_BITS) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, k = length - GRAM + 1, 1
    while 2 * k <= width:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    if k < width:
        m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
    at = (m & low).astype(np.int64)  # of the window that starts here
    starts = np.cumsum(sizes) - sizes
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[starts < len(at)]] = True
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(at))
    text = np.searchsorted(starts, first, "right") - 1
    stop = np.minimum(stop, starts[text] + sizes[text] - length + 1)
    fine = stop > first
    first, stop, text = first[fine], stop[fine], text[fine]
    power, inverse = _weights(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power)))
    same = (total[stop + length - GRAM] - total[first]) * inverse[first]
    return text, first - starts[text], stop - first, at[first] - first, h[at[first]], same


def _doc(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text_col).alias("ver")]


_PLACE = "h long, s long, id long, ver long, lo int, m int, off int"


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _PLACE.split(", ")]
    for b in batches:
        texts = [t.as_py() or b"" for t in b.column(2)]
        ids, vers = b.column(0).to_numpy(), b.column(1).to_numpy()
        pieces = [(i, a, t[a : a + SLICE + length - 1]) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - length + 1), SLICE)]
        at = 0
        while at < len(pieces):
            to, n = at, 0
            while to < len(pieces) and n < SLICE:
                n += len(pieces[to][2])
                to += 1
            which, lo, m, off, h, s = anchors([x[2] for x in pieces[at:to]], length)
            if len(h):
                row, begin = (np.array([x[k] for x in pieces[at:to]])[which] for k in (0, 1))
                cols = [h.view(np.int64), s.view(np.int64), ids[row], vers[row], *(x.astype(np.int32) for x in (begin + lo, m, off))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)
            at = to


_LATER, _FIRST = 0, 1


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, s, m, off, id, ver, lo) with their kind: _LATER for what is equal to the row before,
    _FIRST for others. Rows alone under their h go, and so do repeats of a row.

    A task's first row is taken as a first, and its outer rows stay: a row too many does no harm, as the index finds
    segments that are equal too.
    """
    held: pa.Table | None = None
    begun = False

    def sent(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        """All rows of t but the ends, which only give the neighbours: its first row if begun, its last unless last."""
        col = {n: t.column(n).to_numpy() for n in ("h", "s", "m", "off", "id", "ver", "lo")}
        n = t.num_rows
        equal = lambda *names: np.concatenate(([False], np.logical_and.reduce([col[x][1:] == col[x][:-1] for x in names])))
        near = equal("h")
        later = equal("h", "s", "m", "off")
        again = later & equal("id", "ver", "lo")
        keep = near | np.append(near[1:], False)
        if not begun:
            keep[0] = True
        if last:
            keep[-1] = True
        keep &= ~again
        at = np.flatnonzero(keep)
        at = at[(at >= int(begun)) & (at < n - int(not last))]
        if len(at):
            kind = pa.array(np.where(later[at], _LATER, _FIRST).astype(np.int32))
            yield from t.take(pa.array(at)).append_column("kind", kind).combine_chunks().to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        if t.num_rows - int(begun) < 2:
            held = t
            continue
        yield from sent(t, False)
        held, begun = t.slice(t.num_rows - 2), True
    if held is not None:
        yield from sent(held, True)


def _classes(rows: DataFrame, name: str) -> DataFrame:
    """rows (h, s, m, off, id, ver, lo, …) with ``kind``, written. Dealt by ranges that end inside a hot anchor too."""
    dealt = rows.repartitionByRange("h", "s", "id").sortWithinPartitions("h", "s", "m", "off", "id", "ver", "lo")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return written(dealt.mapInArrow(_classed, f"{kinds}, kind int"), name)


def _grouped(classed: DataFrame) -> DataFrame:
    """The first rows of anchors that have two or more of them, with their number ``c``."""
    firsts = classed.where(F.col("kind") == _FIRST).drop("kind", "s")
    return firsts.join(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1), "h")


_PIECE = "h long, c long, id long, ver long, lo int, m int, off int, piece binary"


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, ver, text, found) to the pieces of text that are found."""
    for b in batches:
        found = b.column(3)
        part = np.repeat(np.arange(b.num_rows), found.value_lengths().to_numpy())
        h, c, lo, m, off = found.flatten().flatten()
        texts = [t.as_py() or b"" for t in b.column(2)]
        a = lo.to_numpy()
        z = a + m.to_numpy() + length - 1
        pieces = pa.array([texts[i][x:y] for i, x, y in zip(part.tolist(), a.tolist(), z.tolist(), strict=True)], pa.binary())
        at = pa.array(part)
        yield pa.RecordBatch.from_arrays([h, c, b.column(0).take(at), b.column(1).take(at), lo, m, off, pieces], names=["h", "c", "id", "ver", "lo", "m", "off", "piece"])


def _finer(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Segments of crowded anchors cut by how far before the anchor their windows start, ``width`` starts a cut. The
    windows of a cut have all but a few bytes in common, and those common bytes are the new anchor. Where a piece's
    windows begin further on than the cut does, offsets stay those of the whole cut."""
    kinds = [("h", pa.int64()), ("s", pa.int64()), ("id", pa.int64()), ("ver", pa.int64()), ("lo", pa.int32()), ("m", pa.int32()), ("off", pa.int32()), ("piece", pa.binary())]
    signed = lambda x: x - (1 << 64) * (x >> 63)
    for b in batches:
        rows = []
        for h, i, v, lo, m, off, piece in zip(*(b.column(k).to_pylist() for k in ("h", "id", "ver", "lo", "m", "off", "piece")), strict=True):
            for k in range((off - m + 1) // width, off // width + 1):
                first, last = max(0, off - width * (k + 1) + 1), min(m - 1, off - width * k)
                core = piece[off - width * k : off - width * (k + 1) + 1 + length]
                own = piece[first : last + length]
                rows.append((signed(xxhash.xxh64_intdigest(core, (h + k) & (1 << 64) - 1)), signed(xxhash.xxh64_intdigest(own, h & (1 << 64) - 1)), i, v, lo + first, last - first + 1, off - first, own))
        cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])


class _Meeting:
    """Distinct segments of whole groups that wait for their round: group, number, where in the document they begin,
    and bytes. What is left of one keeps its number; no two windows of a segment are equal. A round takes the first
    segment of each group as the index of the others."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.group, self.own, self.lo = (np.zeros(0, np.int64) for _ in range(3))
        self.data: list[bytes] = []

    def add(self, group: np.ndarray, own: np.ndarray, lo: np.ndarray, data: list[bytes]) -> None:
        """Groups in one piece, segments of a group in their order."""
        self.group, self.own, self.lo = np.append(self.group, group), np.append(self.own, own), np.append(self.lo, lo)
        self.data += data

    def size(self) -> int:
        return sum(map(len, self.data))

    def round(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, start, end) of the bytes matched."""
        new = np.concatenate(([True], self.group[1:] != self.group[:-1]))
        at = np.flatnonzero(new)
        ref = self.own == self.own[at][np.cumsum(new) - 1]
        refs, rest = np.flatnonzero(ref), np.flatnonzero(~ref)
        index = RunLengthIndex([self.data[i] for i in refs.tolist()])
        data = [self.data[i] for i in rest.tolist()]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        stops = np.cumsum(sizes)
        reach = index.matching(np.frombuffer(b"".join(data), np.uint8), stops - sizes, stops)
        windows = np.ones(len(reach), bool)  # whether a window starts here
        tails = (stops[:, None] - np.arange(1, self.length)[None, :]).ravel()
        windows[tails] = False
        hit = reach >= self.length
        of = np.repeat(np.arange(len(data)), sizes)
        base = (stops - sizes)[of]
        spans = []
        for flags in (hit, windows & ~hit):
            edge = np.ones(len(flags), bool)
            edge[1:] = (flags[1:] != flags[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], len(flags))
            good = flags[begin]
            spans.append((begin[good], end[good]))
        (a, z), (c, d) = spans
        rows = rest[of[a]]
        found = self.own[rows], self.lo[rows] + a - base[a], self.lo[rows] + z - base[a] + self.length - 1
        rows = rest[of[c]]
        left = [self.data[r][x:y] for r, x, y in zip(rows.tolist(), (c - base[c]).tolist(), (d - base[c] + self.length - 1).tolist(), strict=True)]
        self.group, self.own, self.lo, self.data = self.group[rows], self.own[rows], self.lo[rows] + c - base[c], left
        self._drop_alone()
        return found

    def _drop_alone(self) -> None:
        """Groups with one segment left have nothing to meet."""
        if not len(self.group):
            return
        new = np.concatenate(([True], self.group[1:] != self.group[:-1]))
        number = np.cumsum(new) - 1
        low, high = (f.reduceat(self.own, np.flatnonzero(new)) for f in (np.minimum, np.maximum))
        keep = np.flatnonzero((low != high)[number])
        self.group, self.own, self.lo, self.data = self.group[keep], self.own[keep], self.lo[keep], [self.data[i] for i in keep.tolist()]


def _indexed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Distinct segments sorted by (h, id, ver, lo) to byte spans (id, ver, start, end) that occur earlier."""
    meeting = _Meeting(length)
    ids, vers = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the segments in the meeting
    groups = waiting = 0
    held: pa.Table | None = None

    def rounds(enough: int) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, ids, vers
        while len(meeting.data) and waiting > enough:
            own, start, end = meeting.round()
            waiting = meeting.size()
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(vers[own]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["id", "ver", "start", "end"])
        left, meeting.own = np.unique(meeting.own, return_inverse=True)
        ids, vers = ids[left], vers[left]

    def taken(t: pa.Table) -> None:
        nonlocal groups, waiting, ids, vers
        h, i, v, lo = (t.column(n).to_numpy() for n in ("h", "id", "ver", "lo"))
        other = np.concatenate(([True], h[1:] != h[:-1]))
        fresh = np.flatnonzero(other | np.concatenate(([True], (i[1:] != i[:-1]) | (v[1:] != v[:-1]) | (lo[1:] != lo[:-1]))))  # rows that repeat go
        number = np.arange(len(fresh)) + len(ids)
        ids, vers = np.append(ids, i[fresh]), np.append(vers, v[fresh])
        data = t.column("piece").take(pa.array(fresh)).to_pylist()
        meeting.add((np.cumsum(other) - 1)[fresh] + groups, number, lo[fresh].astype(np.int64), data)
        meeting._drop_alone()
        groups += int(other.sum())
        waiting = meeting.size()

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        h = t.column("h").to_numpy()
        last = int(np.searchsorted(h, h[-1], "left"))
        if last:
            taken(t.slice(0, last))
            yield from rounds(BLOCK)
        held = t.slice(last)
    if held is not None:
        taken(held)
    yield from rounds(0)


def repeated_spans(docs: DataFrame, length: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ver, spans): for each document with bytes to remove, the spans (start, end) in bytes, not merged.

    id is the document's id (the least long for null), ver a hash of its text; documents are in the order of both.
    Segments count as equal if their 64-bit hashes and those of their anchors are.
    """
    if not GRAM + 40 <= length:
        raise ValueError(f"length must be {GRAM + 40} or more")
    bounded_batches(docs.sparkSession)
    own = docs.select(*_doc(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    places = written(own.mapInArrow(lambda b: _anchor_rows(b, length), _PLACE), "anchors")
    classed = _classes(places, "classes")
    release(places)
    asked = _grouped(classed).groupBy("id", "ver").agg(F.collect_list(F.struct("h", "c", "lo", "m", "off")).alias("found"))
    pieces = written(own.join(asked, ["id", "ver"]).select("id", "ver", "text", "found").mapInArrow(lambda b: _cut(b, length), _PIECE), "pieces")
    equal, tables = [classed], [classed, pieces]
    sharded, crowded = pieces.where(F.col("c") <= CROWD), pieces.where(F.col("c") > CROWD)
    for width in WIDTHS:
        if crowded.isEmpty():
            break
        cuts = crowded.mapInArrow(lambda b, width=width: _finer(b, length, width), f"{_PLACE}, piece binary")
        equal.append(_classes(cuts, "cuts"))
        finer = written(_grouped(equal[-1]).select(*pieces.columns), "finer")
        tables += [equal[-1], finer]
        enough = CROWD if width > 1 else 1 << 62
        sharded, crowded = sharded.unionByName(finer.where(F.col("c") <= enough)), finer.where(F.col("c") > enough)
    order = ["h", "id", "ver", "lo"]
    met = sharded.select(*order, "piece").repartition("h").sortWithinPartitions(*order)
    spans = met.mapInArrow(lambda b: _indexed(b, length), "id long, ver long, start int, end int")
    for each in equal:
        later = each.where(F.col("kind") == _LATER)
        spans = spans.unionByName(later.select("id", "ver", F.col("lo").alias("start"), (F.col("lo") + F.col("m") + length - 1).alias("end")))
    spans = written(spans.groupBy("id", "ver").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    release(*tables)
    return spans


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(what stays of the bytes, number of maximal removed runs)."""
    kept, at, runs, end = [], 0, 0, -1
    for a, z in sorted(spans):
        if a > end:
            kept.append(raw[at:a])
            runs += 1
        at = end = max(end, z)
    kept.append(raw[max(at, 0) :])
    return b"".join(kept), runs


def dedup_bytes(docs: DataFrame, length: int = 100, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): one row per input row, kept the remaining bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id,
    or earlier in the same one. Null texts count as empty. Rows that share an id but not the text are in the order of
    a hash of the text; rows equal in both are one document and get the same result; a null id is the smallest.
    Columns besides the two named are not read; an empty table gives no rows.
    """
    spans = repeated_spans(docs, length, id_col=id_col, text_col=text_col)
    own = docs.select(F.col(id_col).alias("own"), *_doc(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    joined = own.join(spans, ["id", "ver"], "left").select("own", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, kept = [], [], []
            for t, s in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = t.as_py() or b""
                stay, n = without(raw, [(x["start"], x["end"]) for x in s]) if s else (raw, 0)
                sizes.append(len(raw))
                runs.append(n)
                kept.append(stay)
            left = [n - len(k) for n, k in zip(sizes, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(left, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"own {joined.schema['own'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("own", id_col)


def digest(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return done.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
