"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are made where the text is and written once; equal ones become one row. A vantage-point tree fitted on
a bounded sample deals the distinct fingerprints into shards: each goes to its own leaf and, where a node's
boundary is within reach, by the triangle inequality, also to the inner side, so every linked pair meets in a leaf.
Leaves split further in memory the same way and compare what is left exactly. A leaf reports its components as
stars, never all pairs; the stars are joined into components by distributed min-label steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.llm.common import bounded_batches, release, written
from slabwise.llm.components import components

BITS, SEED = 64, 42
#: Distinct fingerprints on which the top of the tree is fitted, at most.
SAMPLE = 16_384
#: Distinct fingerprints that a shard should hold, and leaves of the broadcast tree at most.
SHARD, LEAVES = 512, 4096
#: Distinct fingerprints of a shard that meet in one task, at most; they split further in memory. Larger shards are
#: blocks in pairs; those far over the mean are too, for more tasks, but of this many blocks, so that copies are few.
MOST, PARTS = 2_000_000, 16
LEAF = 1024


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """Unsigned XXH64 of each run of ``shingle`` words, repeats included; of the whole sequence if it is shorter."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    pieces = (joined[a:b] for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(starts))


def simhash(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(h), 1 << 15):
        part = h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    return simhash(shingle_hashes(raw, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made)], names=["id", "fp"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, fp long")


def _apart(x: np.ndarray, p: int) -> np.ndarray:
    return np.bitwise_count(x ^ np.uint64(p))


class VantageTree:
    """Nodes (vantage point, radius, inner, outer); leaves are shard numbers, stored as -1 - number."""

    def __init__(self, sample: np.ndarray, shards: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.shards = 0
        self.root = self._grow(sample, shards)

    def _grow(self, x: np.ndarray, shards: int) -> int:
        if shards > 1 and len(x) > 1:
            p = int(x[0])
            d = _apart(x, p)
            radius = int(np.median(d))
            inner = d <= radius
            if 0 < inner.sum() < len(x):
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                self.nodes[at] = (p, radius, self._grow(x[inner][::-1], (shards + 1) // 2), self._grow(x[~inner][::-1], shards // 2))
                return at
        self.shards += 1
        return -self.shards

    def route(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of each fingerprint's own leaf and of the inner leaves whose boundary it overlaps."""
        rows, shards, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), -1 - node))
                continue
            p, radius, inner, outer = self.nodes[node]
            d = _apart(x[at], p)
            todo.append((inner, at[d <= radius + reach]))
            todo.append((outer, at[d > radius]))
        return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spread(x: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, int]]:
    """Components of distinct fingerprints compared with one another: each time one point takes what is near out of
    the rest, so a dense group is left after few steps."""
    rest = x
    while len(rest):
        root, rest = rest[0], rest[1:]
        group, todo = [root], [root]
        while todo and len(rest):
            near = _apart(rest, todo.pop()) <= reach
            if near.any():
                found, rest = rest[near], rest[~near]
                group += found.tolist()
                todo += found.tolist()
        if len(group) > 1:
            yield np.array(group, np.uint64)


def leaf_links(x: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Groups of linked fingerprints among distinct ones; groups from different parts may overlap."""
    if len(x) <= LEAF:
        linked = np.zeros(len(x), bool)
        for a in range(0, len(x), 256):
            linked[a : a + 256] = (np.bitwise_count(x[a : a + 256, None] ^ x[None, :]) <= reach).sum(axis=1) > 1
        if linked.any():
            yield from _spread(x[linked], reach)
        return
    d = _apart(x, int(x[0]))
    radius = int(np.median(d))
    inner, outer = x[d <= radius + reach], x[d > radius]
    if len(inner) > 0.95 * len(x) or not len(outer):
        yield from _spread(x, reach)
        return
    yield from leaf_links(np.roll(inner, -1), reach)
    yield from leaf_links(np.roll(outer, -1), reach)


def link_components(fps: DataFrame, reach: int = 3) -> DataFrame:
    """Distinct longs (fp) to (node, root): their components of links at ``reach`` or fewer differing bits, in the
    order of signed longs; fingerprints that are roots or have no link are left out."""
    spark = fps.sparkSession
    n = fps.count()
    picked = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    sample = np.array(picked, np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(sample, max(1, min(LEAVES, n // SHARD))))
    bounded_batches(spark)

    def dealt(batches: Iterator[pa.RecordBatch], parts: dict[int, int] | None = None) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).to_numpy().view(np.uint64)
            rows, shards = tree.value.route(x, reach)
            key, fp = shards * (1 << 40), x[rows]
            if parts:  # a large shard: blocks of it meet pair by pair
                count = np.array([parts.get(int(s), 1) for s in np.arange(tree.value.shards)])[shards]
                block = ((fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % count
                times = np.repeat(np.arange(len(fp)), count)
                other = np.arange(len(times)) - np.repeat(np.cumsum(count) - count, count)
                lo, hi = np.minimum(block[times], other), np.maximum(block[times], other)
                key, fp = key[times] + lo * (1 << 20) + hi, fp[times]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["key", "fp"])

    sizes = {int(r[0]) >> 40: r[1] for r in fps.mapInArrow(dealt, "key long, fp long").groupBy("key").count().collect()}
    usual = max(SHARD, sum(sizes.values()) // max(1, len(sizes)))
    parts = {s: max(-(-k // MOST), min(PARTS, -(-k // (2 * usual)))) for s, k in sizes.items() if k > min(MOST, 3 * usual)}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            for group in leaf_links(np.unique(np.concatenate(held)), reach) if held else ():
                g = group.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.full(len(g), g.min()))], names=["u", "v"])

        for b in batches:
            keys, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for k, part in zip(keys[np.concatenate(([0], cuts))] if len(keys) else [], np.split(x, cuts), strict=False):
                if k != key:
                    yield from links()
                    key, held = k, []
                held.append(part)
        yield from links()

    meet = fps.mapInArrow(lambda b: dealt(b, parts), "key long, fp long").repartition("key").sortWithinPartitions("key")
    edges = meet.mapInArrow(joined, "u long, v long")
    return components(edges)


def fingerprint_groups(made: DataFrame, reach: int = 3) -> DataFrame:
    """(id, fp) to (fp, component), written: the smallest id among the fingerprints that links join to fp, itself
    included."""
    fps = written(made.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    comp = link_components(fps.select("fp"), reach)
    rooted = written(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = written(rooted.select("fp", "root").join(first, "root").select("fp", "component"), "named")
    release(fps, rooted)
    return named


def near_duplicates(docs: DataFrame, reach: int = 3, shingle: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): one row per input row; component is the smallest id reachable, itself included.

    A-Z are lower-cased and words end at ASCII blanks; null and empty texts have fingerprint 0 and link as any other.
    Repeated rows and ids share a fingerprint's component; a null id is never the smallest unless all are null.
    Columns besides the two named are not read. An empty table gives no rows.
    """
    made = written(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "fingerprints")
    named = fingerprint_groups(made, reach)
    out = written(made.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component"), "components")
    release(made, named)
    return out


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Near copies at a share of common shingles. Fingerprints of the shingle sets go through the vantage-point tree first,
# and what it links are candidates. Sets that share four fifths may differ in 18 bits, where triangle bounds prune
# nothing, so for the links beyond its reach texts are dealt by minima of their shingles under a few orders: two sets
# that share four fifths miss each other in all of them once in 244 million times. Only the minima whose texts the
# tree has not linked with one another yet make a group; one that a common passage makes large is dealt again by a
# second minimum. Inside a group a sketch that travels with the texts picks candidates, so loosely that it loses no
# link to speak of. The sets of candidates' components, by either way, then meet once, and every link is confirmed
# there by the exact share of common shingles.

SKETCH = 128
#: What is taken off the similarity for the error of the estimate, over eight standard deviations of it at 0.8.
SLACK = 0.3
#: Orders by which documents are dealt.
DEALS = 12
#: Documents of a group compared in one task, half of them; groups that stay larger meet in parts.
GROUP_BLOCK = 1000
#: Hashes of the shingle sets that are confirmed in one task, half of them.
SET_BLOCK = 1_000_000
#: Keys that are broadcast to the texts or to other keys, at most; with more, both sides are shuffled.
BROADCAST_KEYS = 300_000
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(h: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SKETCH multiplications; zeros without hashes."""
    if not len(h):
        return np.zeros(SKETCH, np.uint64)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), 4096):
        least = np.minimum(least, (h[a : a + 4096, None] * _ODD[None, :]).min(axis=0))
    return least


def sketch(least: np.ndarray) -> bytes:
    """16 mixed bits of each minimum: the share of equal places estimates the share of common shingles."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16).tobytes()


def _alike(sig: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """Groups of positions, candidates for one another by sketches that agree in a share ``least`` or more."""
    rest = np.arange(len(sig))
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        group, todo = [root], [root]
        while todo and len(rest):
            p = todo.pop()
            near = np.flatnonzero((sig[rest] == sig[p]).mean(axis=1) >= least)
            if len(near):
                found = rest[near].tolist()
                rest = np.delete(rest, near)
                group += found
                todo += found
        if len(group) > 1:
            yield np.array(group)


def exact_groups(sets: list[np.ndarray], least: float) -> Iterator[np.ndarray]:
    """Groups of positions linked by sets of distinct hashes of which ``least`` or more of the union is common."""
    sizes = np.array([len(x) for x in sets], np.int64)
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [codes[b - n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
    mark = np.zeros(len(values), np.int64)
    rest = np.flatnonzero(sizes)
    held, flat, starts = rest, codes, (ends - sizes)[rest]
    alive = np.ones(len(sets), bool)
    while len(rest):
        root = int(rest[0])
        alive[root] = False
        rest = rest[1:]
        group, todo = [root], [root]
        while todo and len(rest):
            p = todo.pop()
            if 2 * len(rest) < len(held):
                held, flat = rest, np.concatenate([own[q] for q in rest.tolist()])
                starts = np.cumsum(sizes[held]) - sizes[held]
            mark[own[p]] = 1
            common = np.add.reduceat(mark[flat], starts)
            mark[own[p]] = 0
            found = held[(common / (sizes[held] + sizes[p] - common) >= least) & alive[held]]
            if len(found):
                alive[found] = False
                rest = rest[alive[rest]]
                group += found.tolist()
                todo += found.tolist()
        if len(group) > 1:
            yield np.array(group)


def _links(make: Callable[[bool], DataFrame], large: bool, group: list[str], joined: Callable, before: DataFrame | None = None) -> DataFrame:
    """(u, v), written, that ``joined`` finds among the rows of each group; what it leaves out is linked by others,
    those in ``before`` too.

    make(False) gives (*group, parts, node, …), make(True) those of groups of several parts, if there are ``large``
    ones. The rows of a large group meet in two rounds, so that they are not copied to every part. First a part meets
    the first one. Nodes that are linked by then, by whatever way, need not meet; in a cluster of copies that is nearly
    all of them. So then only those outside the largest linked set of their group meet the rest of it.
    """

    def met(df: DataFrame) -> DataFrame:
        found = df.drop("parts").repartition(*group, "pair").sortWithinPartitions(*group, "pair").mapInArrow(joined, "u long, v long")
        return written(found, "links")

    own = lambda n, *salt: F.pmod(F.xxhash64("node", *salt), F.col(n)).cast("int")
    rows = make(False)
    kept = [c for c in rows.columns if c not in (*group, "parts")]
    to = F.when(own("parts") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own("parts")))
    first = met(rows.select(*group, "parts", F.explode(to).alias("pair"), *kept).withColumn("pair", F.col("pair").cast("long")))
    if not large:
        return first
    linked = components(first if before is None else first.unionByName(before))
    named = make(True).join(linked, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    named = written(named, "named")
    sizes = named.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy(*group).agg(F.max_by("label", F.struct("c", "label")).alias("top"), (F.sum("c") - F.max("c")).alias("rest"), F.sum("c").alias("all")).where("rest > 0")
    again = named.join(tops, group).withColumn("others", F.ceil(F.col("parts") * F.col("rest") / F.col("all")).cast("int"))
    pair = lambda other, mine: (other.cast("long") * (1 << 31) + mine).alias("pair")
    every = again.select(*group, "parts", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("o"), *kept).withColumn("pair", pair(F.col("o"), own("parts"))).drop("o")
    rest = again.where("label <> top").select(*group, "parts", "others", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("m"), *kept).withColumn("pair", pair(own("others", F.lit(3)), F.col("m"))).drop("m", "others")
    second = met(every.unionByName(rest))
    release(named)
    return first.unionByName(second)


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def _confirmed(own: DataFrame, nodes: DataFrame, comp: DataFrame, min_similarity: float, shingle: int) -> DataFrame:
    """(u, v) of the exact links inside candidates' components (node, root)."""
    placed = written(nodes.select("node", "one", "v1", "v2", "n").join(comp, "node", "left").select("node", "one", "v1", "v2", "n", F.coalesce("root", "node").alias("root")), "placed")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("n") / SET_BLOCK)).cast("int")
    counts = placed.groupBy("root").agg(F.count(F.lit(1)).alias("c"), parts.alias("parts")).where("c > 1")
    members = written(placed.join(counts, "root").select("root", "node", "one", F.col("v1").alias("w1"), F.col("v2").alias("w2"), "parts"), "members")
    release(placed)
    same = (F.col("v1") == F.col("w1")) & (F.col("v2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("one"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary())], names=["home", "parts", "node", "hashes"])

    def make(large: bool) -> DataFrame:
        some = members.where("parts > 1") if large else members
        texts = own.join(_few(some), same).select(F.col("root").alias("home"), "parts", "node", "text")  # one of equal texts
        return texts.mapInArrow(sets, "home long, parts int, node long, hashes binary")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            node = np.array(list(held), np.int64)
            for g in exact_groups([np.frombuffer(x, np.uint64) for x in held.values()], min_similarity):
                yield pa.RecordBatch.from_arrays([pa.array(node[g]), pa.array(np.full(len(g), node[g].min()))], names=["u", "v"])

        for b in batches:
            for root, pair, node, hashes in zip(*(b.column(n).to_pylist() for n in ("home", "pair", "node", "hashes")), strict=True):
                if (root, pair) != key:
                    yield from links()
                    key, held = (root, pair), {}
                held[node] = hashes  # a row may come twice
        yield from links()

    found = _links(make, not members.where("parts > 1").isEmpty(), ["home"], joined)
    release(members)
    return found


def _dealt(nodes: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(key, parts, node, known, sig): texts that share a minimum under one of the orders have a key in common; keys
    whose texts are all known to be linked are left out. Besides, the same for keys of several parts, and whether
    there are any."""
    each = nodes.select("node", "known", "sig", "deal", F.posexplode("deal").alias("j", "m")).select("node", "known", "sig", "deal", "j", F.xxhash64("j", "m").alias("key"))

    def open_keys(df: DataFrame) -> DataFrame:
        counts = df.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("known").alias("lo"), F.max("known").alias("hi"))
        return written(counts.where("lo < hi").select("key", "c"), "keys")

    keys = open_keys(each.select("key", "known"))
    direct = each.join(_few(keys.where(F.col("c") <= GROUP_BLOCK).select("key")), "key", "left_semi").select("key", F.lit(1).alias("parts"), "node", "known", "sig")
    again = each.join(_few(keys.where(F.col("c") > GROUP_BLOCK).select("key")), "key", "left_semi").select("node", "known", "sig", F.col("j").alias("i"), F.col("key").alias("first"), F.posexplode("deal").alias("j", "m")).where("i <> j")
    second = F.xxhash64("j", "m")  # the two minima in one order, so that two large ones make one group
    again = again.withColumn("key", F.when(F.col("i") < F.col("j"), F.xxhash64("first", second)).otherwise(F.xxhash64(second, "first"))).select("key", "node", "known", "sig").dropDuplicates(["key", "node"])
    pairs = open_keys(again.select("key", "known"))
    sized = again.join(_few(pairs), "key").select("key", F.ceil(F.col("c") / GROUP_BLOCK).cast("int").alias("parts"), "node", "known", "sig")
    return direct.unionByName(sized), sized.where("parts > 1"), not pairs.where(F.col("c") > GROUP_BLOCK).isEmpty()


def _near(docs: DataFrame, min_similarity: float, shingle: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(id, v1, v2, root): one row per input row, written; v1 and v2 tell its text, root its component."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), *_versions(text_col), F.col(text_col).cast("binary").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in b.column(3)]
            least = [minima(h) for h in each]
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in each], pa.binary())
            fp = pa.array(np.array([simhash(h) for h in each], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], same, fp, pa.array([m[:DEALS].view(np.int64) for m in least], pa.list_(pa.int64())), pa.array([sketch(m) for m in least], pa.binary()), pa.array(map(len, each), pa.int64())], names=["id", "v1", "v2", "same", "fp", "deal", "sig", "n"])

    marks = written(own.mapInArrow(made, f"id {own.schema['id'].dataType.simpleString()}, v1 long, v2 long, same binary, fp long, deal array<long>, sig binary, n long"), "sketches")
    first = F.min_by(F.struct("fp", "sig", "deal", "n", "v1", "v2", F.col("id").alias("one")), F.struct("v1", "v2", "id")).alias("x")
    texts = written(marks.groupBy("same").agg(first).select("same", "x.*", F.monotonically_increasing_id().alias("node")), "texts")
    named = fingerprint_groups(texts.select(F.col("node").alias("id"), "fp"), reach)
    nodes = written(texts.join(named, "fp").withColumnRenamed("component", "known"), "nodes")
    release(texts, named)
    bits = nodes.where("node <> known").select(F.col("node").alias("u"), F.col("known").alias("v"))
    lowest = min_similarity - SLACK

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in held) < 2:
                return
            node, known, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            if known.min() == known.max():
                return
            node, once = np.unique(node, return_index=True)  # a row may come twice
            for g in _alike(sig[once], lowest):
                yield pa.RecordBatch.from_arrays([pa.array(node[g]), pa.array(np.full(len(g), node[g].min()))], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            k, pair, node, known = (b.column(n).to_numpy() for n in ("key", "pair", "node", "known"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SKETCH)
            cuts = (np.flatnonzero((np.diff(k) != 0) | (np.diff(pair) != 0)) + 1).tolist()
            for at, to in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if (k[at], pair[at]) != key:
                    yield from links()
                    key, held = (k[at], pair[at]), []
                held.append((node[at:to], known[at:to], sig[at:to]))
        yield from links()

    rows, hot, large = _dealt(nodes)
    edges = _links(lambda only: hot if only else rows, large, ["key"], joined, bits).unionByName(bits)
    comp = components(_confirmed(own, nodes, components(edges), min_similarity, shingle))
    rooted = written(nodes.join(comp, "node", "left").select("same", F.coalesce("root", "node").alias("root")), "rooted")
    out = written(marks.select("id", "v1", "v2", "same").join(rooted, "same").select("id", "v1", "v2", "root"), "near")
    release(marks, nodes, rooted)
    return out


def _versions(text_col: str) -> list[Column]:
    return [F.xxhash64(text_col).alias("v1"), F.xxhash64(F.lit(7), text_col).alias("v2")]


def similar_documents(docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, reach: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): one row per input row; documents are linked if their sets of word shingles have
    ``min_similarity`` or more in common. Candidates come from fingerprints at ``reach`` or fewer differing bits and,
    beyond that, from minima: at 0.8 a link is missed once in 244 million times, and where a common passage makes a
    group large, once in 49 million times. component is the smallest id reachable; a null id only if
    all are null. Texts without words are alike. Ids may be of any type that can be ordered; repeated rows and ids
    each get a row. Other columns are not read.
    """
    near = _near(docs, min_similarity, shingle, reach, id_col, text_col)
    least = near.groupBy("root").agg(F.min("id").alias("component"))
    return near.join(least, "root").select(F.col("id").alias(id_col), "component")


def one_of_each(docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, reach: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, one with the smallest id (a null one is the largest); of
    rows that share it, one with the smallest hash of its text. Columns keep their names, whatever they are, and their
    values; an empty table gives no rows. What goes is looked up by the texts, which are not shuffled for it if that
    is little."""
    near = _near(docs, min_similarity, shingle, reach, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "v1", "v2")
    stays = near.groupBy("root").agg(F.min(order).alias("x")).select(F.col("x.id").alias("s"), F.col("x.v1").alias("s1"), F.col("x.v2").alias("s2"))
    rows = near.groupBy("id", "v1", "v2").agg(F.count(F.lit(1)).alias("c"))
    match = F.col("id").eqNullSafe(F.col("s")) & (F.col("v1") == F.col("s1")) & (F.col("v2") == F.col("s2"))
    held = written(rows.join(stays, match, "left").select("id", "v1", "v2", "c", F.col("s1").isNotNull().alias("stays")), "held")
    release(near)
    gone = held.where(~F.col("stays")).select(F.col("id").alias("s"), F.col("v1").alias("s1"), F.col("v2").alias("s2"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), *_versions(text_col))
    kept = row.join(_few(gone), match, "left_anti")
    if not held.where(F.col("stays") & (F.col("c") > 1)).isEmpty():  # rows that repeat wholly
        kept = kept.dropDuplicates(["id", "v1", "v2"])
    return kept.select("row.*")
