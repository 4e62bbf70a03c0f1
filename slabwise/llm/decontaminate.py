"""Benchmark decontamination by a generalised suffix automaton.

The normalised test items form an automaton; training words stream through it, the longest matching suffix is tracked
at each word, and every place where it reaches a window marks the words covered. Items of up to BLOCK_WORDS words in
all are one automaton, which is broadcast. More items are blocks of that size: hashes of windows tell which texts can
match which blocks, texts and blocks meet by a join, and the tasks build the automata, so that neither the driver nor
a broadcast grows with the items, and a text is read three times however many blocks there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import _WORD_BYTES, bounded_batches, release, words_of, written

#: Words of items in one automaton (about two states a word).
BLOCK_WORDS = 100_000
#: Texts that meet a block in one task, about; with more, the block is copied to several.
BLOCK_TEXTS = 5_000
#: Words of the pieces whose least hash stands for a window.
_PIECE = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.trans: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        ends = []
        for name, words in items:
            if not words:
                continue
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            state = 0
            for c in ids:
                state = self._extend(state, c)
            ends.append((name, ids, state))
            self.shortest = min(self.shortest, len(ids))
        owners: list[set[str] | None] = [None] * len(self.link)
        short: list[list | None] = [None] * len(self.link)
        for name, ids, state in ends:
            if len(ids) < window:
                short[state] = [*(short[state] or []), (len(ids), name)]
                continue
            v = n = 0
            for c in ids:
                v, n = self.trans[v][c], n + 1
                if n >= window:
                    u = self._at(v)
                    owners[u] = owners[u] or set()
                    if name is not None:
                        owners[u].add(name)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.short: list[tuple] = [()] * len(self.link)
        for v in order[1:]:  # a shorter item that ends here also ends wherever a longer suffix does
            up = self.short[self.link[v]]
            self.short[v] = up + tuple(short[v]) if short[v] else up
        self.owners = [None] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                self.owners[v] = owners[self._at(v)]

    def _at(self, v: int) -> int:
        """The suffix state whose strings include the last ``window`` words."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _new(self, length: int, trans: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.trans.append(trans)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, dict(self.trans[q]), self.link[q])
        while p >= 0 and self.trans[p].get(c) == q:
            self.trans[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if (q := self.trans[last].get(c)) is not None:
            return self._split(last, c, q)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.trans[p]:
            self.trans[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c, self.trans[p][c])
        return cur

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside occurring windows, and the items that own those windows."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if len(words) < self.shortest or not self.vocab:
            return spans, names
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.shortest
        trans, link, length, owners, short, window = self.trans, self.link, self.length, self.owners, self.short, self.window
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            v = n = 0
            for j, c in enumerate(ids[a:b].tolist(), a + 1):
                nxt = trans[v].get(c)
                if nxt is None:
                    while v and nxt is None:
                        v = link[v]
                        nxt = trans[v].get(c)
                    n = length[v]
                    if nxt is None:
                        n = 0
                        continue
                v, n = nxt, n + 1
                hit = 0
                if n >= window:
                    names |= owners[v]
                    hit = window
                if short[v]:
                    for m, name in short[v]:
                        if m <= n:
                            hit = max(hit, m)
                            if name is not None:
                                names.add(name)
                if hit:
                    if spans and spans[-1][0] <= j - hit <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], j)
                    else:
                        spans.append((j - hit, j))
        return _merged(spans), names


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _gram_hashes(words: list[bytes], known: _WordHashes, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(29)
    return out


def window_marks(words: list[bytes], known: _WordHashes, window: int) -> np.ndarray:
    """Hashes such that texts that share a window share the one it has: the least hash of its pieces."""
    piece = min(_PIECE, window)
    h = _gram_hashes(words, known, piece)
    width = window - piece + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1)).view(np.int64)


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS = "array<struct<start:int,end:int>>"


def _said(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": a, "end": z} for a, z in spans]


def _by_broadcast(own: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """own (id, text) with n_words, spans and items by one automaton."""
    block = [(r[0], words_of(bytes(r[1]) if r[1] is not None else None)) for r in items.collect()]
    shared = own.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for b in batches:
            counts, spans, names = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                found, said = automaton.match(words)
                counts.append(len(words))
                spans.append(_said(found))
                names.append(sorted(said))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counts, pa.int64()), pa.array(spans, _SPAN), pa.array(names, pa.list_(pa.string()))], names=[*b.schema.names, "n_words", "spans", "items"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, text binary, n_words long, spans {_SPANS}, items array<string>")


def _by_blocks(own: DataFrame, items: DataFrame, window: int, block_words: int, total: int) -> DataFrame:
    """The same by automata of ``block_words`` words each, built where texts and blocks meet."""
    blocks = -(-total // block_words)
    step = max(1, block_words - window + 1)
    place = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).alias("block")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Items in pieces that a block can hold; every window is in one."""
        for b in batches:
            rows = []
            for block, name, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(raw)
                for i, a in enumerate(range(0, max(1, len(words) - window + 1), step)):
                    if words:
                        rows.append(((block + i) % blocks, name, b" ".join(words[a : a + step + window - 1]), min(len(words), window)))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.int32()), strict=True)], names=["block", "item", "body", "n"])

    pieces = written(items.select(place, "item", "text").mapInArrow(cut, "block long, item string, body binary, n int"), "items")
    sizes = [r.n for r in pieces.where(F.col("n") < window).select("n").distinct().collect()]  # of items shorter than a window

    def marks(raw: bytes | None, known: _WordHashes, short: list[int]) -> np.ndarray:
        words = words_of(raw)
        return np.concatenate([window_marks(words, known, window), *(np.unique(_gram_hashes(words, known, n)).view(np.int64) for n in short)])

    def item_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in batches:
            each = [marks(t.as_py(), known, [n] if n < window else []) for t, n in zip(b.column(1), b.column(2).to_pylist(), strict=True)]
            at = np.repeat(np.arange(b.num_rows), list(map(len, each)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(each))], names=["block", "mark"])

    def text_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = _WordHashes()
            each = [marks(t.as_py(), known, sizes) for t in b.column(2)]
            at = pa.array(np.repeat(np.arange(b.num_rows), list(map(len, each))))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(each))], names=["v1", "v2", "mark"])

    texts = own.select(F.xxhash64("text").alias("v1"), F.xxhash64(F.lit(7), "text").alias("v2"), "text")
    asked = pieces.select("block", "body", "n").mapInArrow(item_marks, "block long, mark long").distinct()
    meet = texts.mapInArrow(text_marks, "v1 long, v2 long, mark long").join(asked, "mark").select("block", "v1", "v2").distinct()
    routes = written(meet, "routes")
    copies = routes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS).alias("copies"))
    needed = texts.join(routes.select("v1", "v2").distinct(), ["v1", "v2"], "left_semi").groupBy("v1", "v2").agg(F.first("text").alias("body"))
    right = routes.join(copies, "block").withColumn("copy", F.pmod("v1", "copies")).join(needed, ["v1", "v2"]).select("block", "copy", F.lit(1).alias("side"), F.lit(None).cast("string").alias("item"), "v1", "v2", "body")
    left = pieces.join(copies, "block").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select("block", "copy", F.lit(0).alias("side"), "item", F.lit(0).cast("long").alias("v1"), F.lit(0).cast("long").alias("v2"), "body")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, automaton = None, [], None
        for b in batches:
            rows = []
            for block, copy, side, item, v1, v2, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (block, copy) != key:
                    key, held, automaton = (block, copy), [], None
                if side == 0:
                    held.append((item, words_of(body)))
                    continue
                automaton = automaton or SuffixAutomaton(held, window)
                spans, names = automaton.match(words_of(body))
                if spans:
                    rows.append((v1, v2, _said(spans), sorted(names)))
            cols = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), _SPAN, pa.list_(pa.string())), strict=True)], names=["v1", "v2", "spans", "items"])

    found = left.unionByName(right).repartition("block", "copy").sortWithinPartitions("block", "copy", "side").mapInArrow(joined, f"v1 long, v2 long, spans {_SPANS}, items array<string>")
    found = found.groupBy("v1", "v2").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = written(found, "found")
    release(routes, pieces)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [len(words_of(t.as_py())) for t in b.column(1)]
            spans = [_said(_merged([(x["start"], x["end"]) for x in s or ()])) for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPAN), b.column(3)], names=["id", "text", "n_words", "spans", "items"])

    both = own.withColumn("v1", F.xxhash64("text")).withColumn("v2", F.xxhash64(F.lit(7), "text")).join(found, ["v1", "v2"], "left")
    both = both.select("id", "text", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return both.mapInArrow(ended, f"id {own.schema['id'].dataType.simpleString()}, text binary, n_words long, spans {_SPANS}, items array<string>")


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 8, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, keep_text: bool = False) -> DataFrame:
    """(id, n_words, spans, items[, text]): one row per document, spans of hit word positions, names of items hit.

    Null and empty texts have no words; items without words match nothing; items with a null id mark words but name
    nothing, and items that repeat an id count once. Only the named columns are read, so other columns may clash.
    Repeated documents each get their row; an empty side gives empty hits.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    asked = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words_of(t.as_py())) for t in b.column(1))], pa.int64())], names=["n"])

    total = asked.mapInArrow(counted, "n long").agg(F.sum("n")).first()[0] or 0
    out = _by_broadcast(own, asked.where(F.col("text").isNotNull()), window) if total <= block_words else _by_blocks(own, asked, window, block_words, total)
    out = out.withColumnRenamed("id", id_col)
    return out.withColumn("text", F.col("text").cast("string")) if keep_text else out.drop("text")


def digest(found: DataFrame, id_col: str = "doc_id", min_items: int = 2) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.end - s.start))
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"))


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the words of each span and what stands between them; what is around a span stays."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
    out, done = [], 0
    for a, b in spans:
        out.append(raw[done : at[a][0]])
        done = at[b - 1][1]
    return b"".join([*out, raw[done:]])


def without_passages(docs: DataFrame, items: DataFrame, window: int = 8, *, min_words: int = 13, max_share: float = 0.2, text_col: str = "text") -> DataFrame:
    """``docs`` without the hit spans of ``min_words`` words or more, and without the documents of which hit spans
    cover ``max_share`` or more. Only spans of ``window`` words or more count, so items shorter than a window, which
    any text may hold by chance, take nothing away.

    Null and empty texts stay; repeated rows are cut or go together; columns keep their names and values whatever
    they are called; an empty side changes nothing.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("body"))
    found = find_contamination(row, items, window, id_col="row", text_col="body")
    size = lambda s: s.end - s.start
    hit = F.filter("spans", lambda s: size(s) >= window)
    covered = F.aggregate(hit, F.lit(0).cast("long"), lambda a, s: a + size(s))
    stay = found.where((covered == 0) | (covered < max_share * F.col("n_words"))).select("row", F.filter(hit, lambda s: size(s) >= min_words).alias("cut"))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = b.column(0).flatten()
            texts = fields[at].to_pylist()
            for i, cut in enumerate(b.column(1).to_pylist()):
                if cut:
                    texts[i] = cut_words(texts[i].encode(), [(x["start"], x["end"]) for x in cut]).decode()
            fields[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(fields, names=names)

    return stay.mapInArrow(run, docs.schema)
