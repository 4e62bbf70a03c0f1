"""A blob store over segment files and an index log: open, put, get, evict, compact, recover, close.

A put is one batch: blobs over the large threshold are slabs of their own, the others are packed by next-fit, slabs
rotate through segments, segment files are written, and only then does a log entry make them visible. The index is
the newest log row of each key hash; deletions, reads and cleared visited bits are rows of the same log, so that no
step rewrites the index. A batch that cannot be written makes the store degraded: the first error stays, the newest
batches are kept in memory and reads overlay them.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from threading import Event

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise import config as C
from slabwise.functions import columns as K
from slabwise.operators import bloom, evict, layout, maintain
from slabwise.operators.ordered import running
from slabwise.sources import segfile
from slabwise.tables import drop, file_system, release, written

log = logging.getLogger("slabwise")
_LOG = "seq long, kind string, key_hash long, segment_id long, pos long, size long, flags long"
_BATCH_BITS = 33
#: Log entries after which they are merged into one.
MERGE_AFTER = 32


class Store:
    """``with Store(spark, path, config) as store``. Rows of a put are (key binary, value binary[, checksum long])."""

    def __init__(self, spark: SparkSession, path: str, config: C.StoreConfig | None = None) -> None:
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or C.StoreConfig()
        self.fault: Callable[[str], None] = lambda step: None  # tests raise from it
        self.error: BaseException | None = None
        self.pending: list[DataFrame] = []
        self.hits = self.ghosts = self.deleted = 0
        self.hand: int | None = None
        self.closed = False
        self._initialise()
        self.batch = max(self._batches(), default=0)
        self.filter = self.geometry = None
        self.size = self._live_size()
        self.rebuild_bloom()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Frees what is held in memory, whether written or not; a second time does nothing."""
        if not self.closed:
            self.closed = True
            self.pending.clear()
            release(self.filter)

    # Layout of the folder.

    def _initialise(self) -> None:
        fs, marker = file_system(self.spark, f"{self.path}/.initialized")
        if not fs.exists(marker):
            for shard in range(self.config.shards):
                at = f"{self.path}/segments/{shard:04d}"
                fs.mkdirs(file_system(self.spark, at)[1])
            fs.create(marker, True).close()

    def _batches(self) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/index")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = lambda n: fs.exists(file_system(self.spark, f"{self.path}/index/{n}/_SUCCESS")[1])
        return sorted(int(n) for n in names if n.isdigit() and done(n))

    def _append(self, rows: DataFrame) -> None:
        self.batch += 1
        rows.select(*(f.split()[0] for f in _LOG.split(", "))).write.mode("overwrite").parquet(f"{self.path}/index/{self.batch:012d}")
        done = self._batches()
        if len(done) > MERGE_AFTER:
            whole = written(self._log(), "index")
            newest = whole.groupBy("key_hash", "kind").agg(F.max_by(F.struct("segment_id", "pos", "size", "flags"), "seq").alias("x"), F.max("seq").alias("seq"))
            self.batch += 1
            newest.select("seq", "kind", "key_hash", "x.*").write.parquet(f"{self.path}/index/{self.batch:012d}")
            release(whole)
            for n in done:
                drop(self.spark, f"{self.path}/index/{n:012d}")

    def _log(self) -> DataFrame:
        paths = [f"{self.path}/index/{n:012d}" for n in self._batches()]
        return self.spark.read.schema(_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], _LOG)

    def index(self) -> DataFrame:
        """(key_hash, seq, segment_id, pos, size, flags, visited, bucket) of the live blobs."""
        k = F.col("kind")
        place = k.isin("put", "delete")
        newest = F.max_by(F.struct("kind", "seq", "segment_id", "pos", "size", "flags"), F.when(place, F.col("seq")))
        last = lambda kind: F.coalesce(F.max(F.when(k == kind, F.col("seq"))), F.lit(-1))
        state = self._log().groupBy("key_hash").agg(newest.alias("n"), last("read").alias("read"), last("clear").alias("clear"))
        live = state.where(F.col("n.kind") == "put")
        return live.select("key_hash", "n.seq", "n.segment_id", "n.pos", "n.size", "n.flags", (F.col("read") > F.greatest("clear", "n.seq")).alias("visited"), F.shiftright("n.seq", _BATCH_BITS).alias("bucket"))

    def _live_size(self) -> int:
        return self.index().agg(F.sum("size")).first()[0] or 0

    def stats(self) -> DataFrame:
        return maintain.stats(self.index())

    def _seq(self) -> int:
        """A sequence number after all of the rows before."""
        return (self.batch + 1) << _BATCH_BITS

    # Writing.

    def put(self, rows: DataFrame) -> None:
        """Writes a batch; of a key that repeats in it, any one row stays. Over the limit, the policy evicts."""
        self._check_open()
        own = rows if "checksum" in rows.columns else rows.withColumn("checksum", F.lit(None).cast("long"))
        own = own.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("checksum").cast("long").alias("checksum"))
        own = written(own.withColumn("key_hash", self.config.key_hash(F.col("key"))).dropDuplicates(["key_hash"]), "batch")
        self.pending.append(own)
        if self.error is None:
            try:
                self.drain()
            except Exception as e:  # noqa: BLE001
                self.report(e)
        if self.error is not None:
            for old in self.pending[: -self.config.degraded_keep_batches]:
                release(old)
            self.pending = self.pending[-self.config.degraded_keep_batches :]
        elif self.config.max_size and self.size > self.config.max_size:
            self.evict()

    def drain(self) -> None:
        """Writes what waits in memory, oldest first."""
        while self.pending:
            self._flush(self.pending[0])
            release(self.pending.pop(0))

    def report(self, error: BaseException) -> None:
        """The first error counts: from then on nothing is written."""
        if self.error is None:
            log.error("store %s is degraded: %s", self.path, error)
            self.error = error

    @property
    def degraded(self) -> bool:
        return self.error is not None

    def _flush(self, batch: DataFrame) -> None:
        """Slabs, segments, files, then the log: a file that is not in the log is not visible, and goes in recovery."""
        self.fault("write")
        c = self.config
        seq = self._seq()
        sized = batch.select("key_hash", F.octet_length("value").cast("long").alias("size")).withColumn("writer", F.pmod("key_hash", F.lit(c.flush_concurrency)))
        small = layout.packed(sized.where(layout.route(F.col("size"), c.large_threshold) == "slab"), "writer", ["key_hash"], c.slab_bytes, at="within")
        large = sized.where(layout.route(F.col("size"), c.large_threshold) == "large")
        large = layout.large_slabs(large, "writer", ["key_hash"]).withColumn("within", F.lit(0).cast("long"))
        placed = written(small.unionByName(large.select(*small.columns)), "placed")
        slabs = placed.groupBy("writer", "slab").agg(F.sum("size").cast("long").alias("bytes"))
        slabs = written(layout.rotated(slabs, "writer", c.segment_bytes, at=("start", "end")), "slabs")
        segments = slabs.groupBy("writer", "segment").agg(F.max("end").alias("total"))
        # Segments in a row, cut every PART_BYTES, are the tasks; a longer segment is cut itself, into parts.
        parted, task = F.col("total") > C.PART_BYTES, F.floor(F.col("begin") / C.PART_BYTES)
        segments = written(running(segments, ["writer"], [F.col("segment")], {"begin": F.col("total")}), "segments")
        tasks, longest = segments.agg(F.max(task + F.when(parted, F.floor(F.col("total") / C.PART_BYTES)).otherwise(0)) + 1, F.max("total")).first()
        number = layout.segment_ids(F.col("segment"), F.col("writer"), seq, c.flush_concurrency)
        placed_at = placed.join(slabs, ["writer", "slab"]).join(segments, ["writer", "segment"]).withColumn("pos", F.col("start") + F.col("within"))
        placed_at = placed_at.withColumn("part", F.when(parted, F.floor(F.col("pos") / C.PART_BYTES))).select("key_hash", number.alias("segment_id"), "part", (task + F.coalesce("part", F.lit(0))).alias("task"), "pos")
        made = F.crc32("value") if c.checksum_of is None else c.checksum_of(F.col("value"))
        flags = K.pack_flags(F.coalesce("checksum", made) if c.checksum else F.col("checksum"), F.lit(False), F.lit(0))
        rows = placed_at.join(batch, "key_hash").select("segment_id", "part", "task", "pos", F.col("key_hash").alias("hash"), flags.alias("flags"), "value")
        found = written(segfile.write_placed(rows, self.path, tasks or 1, c.shards, seq), "files")
        if (longest or 0) > C.PART_BYTES:
            release(written(segfile.write_metadata(found.where(F.col("part").isNotNull()), self.path, c.shards, seq), "metadata"))
        self.fault("index")
        entries = _numbered(found, seq)
        self._append(entries)
        self.size = self._live_size()
        self.filter = self._merged_filter(batch)
        release(placed, slabs, segments, found)

    # Reading.

    def get(self, requests: DataFrame) -> DataFrame:
        """requests (key) with (found, tier, value): batches in memory first, then filter, index and files.

        Marks what the index was asked for as visited, counts hits and ghosts of the filter, verifies checksums if the
        options say so (what fails is not found), and drops entries whose files are gone for good.
        """
        self._check_open()
        asked = requests.select(F.col("key").cast("binary").alias("key")).distinct().withColumn("key_hash", self.config.key_hash(F.col("key")))
        memory = self._memory()
        held = asked.join(memory, "key_hash").select("key", "key_hash", F.lit("memtable").alias("tier"), "value")
        rest = asked.join(memory.select("key_hash"), "key_hash", "left_anti")
        maybe = bloom.test(rest.withColumn("h", self._bloom_hash()), "key", "h", self.filter, self.geometry).where("maybe")
        passed = written(rest.join(maybe.select("key"), "key").join(self.index().drop("visited", "bucket"), "key_hash", "left"), "passed")
        entries = passed.where(F.col("segment_id").isNotNull()).withColumn("physical_size", F.col("size"))
        self.fault("read")
        read = written(segfile.read_range(entries, self.path, self.config.shards, _tasks(entries)), "read")
        wrong = F.lit(False)
        if self.config.verify:
            made = F.crc32("value") if self.config.checksum_of is None else self.config.checksum_of(F.col("value"))
            wrong = K.has_checksum(F.col("flags")) & (made != K.checksum(F.col("flags")))
        gone = read.where(F.col("error").isNotNull() & ~K.is_transient(F.col("error")))
        n, lost, ghosts = passed.agg(F.count(F.lit(1))).first()[0], gone.count(), passed.where(F.col("segment_id").isNull()).count()
        self.hits, self.ghosts = self.hits + n, self.ghosts + ghosts + lost
        if self.config.policy == "sieve" and self.error is None and n > ghosts:
            self._append(entries.select(F.lit(self._seq()).alias("seq"), F.lit("read").alias("kind"), "key_hash", "segment_id", "pos", "size", "flags"))
        if lost:
            self._delete(gone)
        good = read.where(F.col("error").isNull() & ~F.coalesce(wrong, F.lit(False))).select("key", "key_hash", F.lit("index").alias("tier"), "value")
        found = held.unionByName(good).select("key", "tier", "value", F.lit(True).alias("__f"))
        out = requests.select(F.col("key").cast("binary").alias("key")).join(found, "key", "left")
        out = written(out.select("key", F.coalesce("__f", F.lit(False)).alias("found"), "tier", "value"), "got")
        release(passed, read)
        return out

    def view(self, requests: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """A caller's function over the rows found, in Arrow batches of (key, found, tier, value)."""
        return self.get(requests).where("found").mapInArrow(fn, schema)

    def _memory(self) -> DataFrame:
        """The newest value of each key in the batches that wait."""
        if not self.pending:
            return self.spark.createDataFrame([], "key_hash long, value binary")
        layers = [b.select("key_hash", F.lit(i).alias("i"), "value") for i, b in enumerate(self.pending)]
        out = layers[0]
        for x in layers[1:]:
            out = out.unionByName(x)
        return out.groupBy("key_hash").agg(F.max_by("value", "i").alias("value"))

    # Filter.

    def _bloom_hash(self) -> Column:
        return F.col("key_hash").bitwiseAND(F.lit((1 << 63) - 1))

    def rebuild_bloom(self) -> None:
        """A filter of the live index, for as many keys as it has or the options expect."""
        live = self.index().select("key_hash", self._bloom_hash().alias("h"))
        self.geometry = bloom.Geometry.of(max(live.count(), self.config.bloom_keys), self.config.bloom_fp_rate)
        old, self.filter = self.filter, written(bloom.build(live, "h", self.geometry), "bloom")
        self.hits = self.ghosts = self.deleted = 0
        if old is not None:
            release(old)

    def _merged_filter(self, added: DataFrame) -> DataFrame:
        old = self.filter
        out = written(bloom.merge(old, bloom.build(added.withColumn("h", self._bloom_hash()), "h", self.geometry)), "bloom")
        release(old)
        return out

    def rebuild_due(self) -> bool:
        keys = max(self.index().count(), 1)
        row = self.spark.range(1).select(*bloom.rebuild_due(F.lit(self.deleted), F.lit(keys), F.lit(self.hits), F.lit(self.ghosts), self.config.bloom_fp_rate)).first()
        return bool(row.rebuild)

    # Deleting.

    def _delete(self, doomed: DataFrame) -> int:
        """Deletes entries (key_hash, segment_id, pos, size, flags), first in the log, then from the counters."""
        self.fault("delete")
        gone = written(doomed.select(F.lit(self._seq()).alias("seq"), F.lit("delete").alias("kind"), "key_hash", "segment_id", "pos", "size", "flags"), "gone")
        n = gone.count()
        self._append(gone)
        release(gone)
        self.deleted += n
        self.size = self._live_size()
        return n

    def evict(self) -> dict[str, int]:
        """One run of the policy: victims, durable deletion, space that holes would give back, counters, and the
        filter if it is stale. Nothing happens at or under the limit."""
        self._check_open()
        c = self.config
        live = written(self.index(), "live")
        total, buckets = live.agg(F.coalesce(F.sum("size"), F.lit(0)), (F.max("bucket") - F.min("bucket") + 1).cast("long")).first()
        needed = total - c.max_size * C.HYSTERESIS_PERCENT // 100 if c.max_size and total > c.max_size else 0
        out = {"victims": 0, "bytes": 0, "punchable": 0}
        if needed:
            chosen = evict.fifo(live, needed, "bucket", "seq", buckets) if c.policy == "fifo" else evict.sieve(live, needed, "bucket", "seq", self.hand, buckets)
            victims = written(chosen, "victims")
            hole = K.punchable(F.col("pos"), F.col("size"))["len"]
            out = victims.agg(F.count(F.lit(1)).alias("victims"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(hole), F.lit(0)).alias("punchable")).first().asDict()
            if c.policy == "sieve":
                after = written(evict.sieve_after(live, victims, "seq", self.hand), "after")
                was = live.where("visited").select("seq")
                cleared = after.where(~F.col("visited")).join(was, "seq", "left_semi")
                hand = after.where("is_hand").select("seq").first()
                self._append(cleared.select(F.lit(self._seq()).alias("seq"), F.lit("clear").alias("kind"), "key_hash", "segment_id", "pos", "size", "flags"))
                self.hand = hand.seq if hand else None
                release(after)
            self._delete(victims)
            release(victims)
            if self.rebuild_due():
                self.rebuild_bloom()
        release(live)
        return out

    def delete_segment(self, segment_id: int) -> int:
        """Deletes all live blobs of a segment, and its file."""
        n = self._delete(self.index().where(F.col("segment_id") == segment_id))
        segfile.remove(self.spark, self.path, segment_id, self.config.shards)
        return n

    def compact(self, below: float = C.COMPACT_BELOW, cycle: int = C.COMPACT_PER_CYCLE) -> list[int]:
        """Puts the live blobs of the emptiest segments again and removes the segments; their numbers."""
        self._check_open()
        files = self.files()
        live = self.index()
        every = segfile.records(files).select("segment_id", F.col("hash").alias("key_hash"), "pos", F.col("logical_size").alias("size"))
        marked = every.join(live.select("key_hash", "segment_id", "pos", F.lit(False).alias("deleted")), ["key_hash", "segment_id", "pos"], "left")
        known = written(marked.withColumn("deleted", F.coalesce("deleted", F.lit(True))), "known")
        doomed = [r.segment_id for r in maintain.compaction_candidates(known, below, cycle).collect()]
        if doomed:
            entries = live.where(F.col("segment_id").isin(doomed)).withColumn("physical_size", F.col("size"))
            read = segfile.read_range(entries, self.path, self.config.shards, _tasks(entries)).where(F.col("error").isNull())
            kept = F.when(K.has_checksum(F.col("flags")), K.checksum(F.col("flags")))
            again = written(read.select(F.lit(b"").alias("key"), "value", kept.alias("checksum"), "key_hash"), "again")
            if not again.isEmpty():
                self._flush(again)
            release(again)
            for s in doomed:
                segfile.remove(self.spark, self.path, s, self.config.shards)
        release(known)
        return doomed

    def files(self) -> DataFrame:
        return segfile.scan_files(self.spark, f"{self.path}/segments")

    def missing_segments(self) -> DataFrame:
        """(segment_id) that the index knows but the folder does not have."""
        there = self.files().select(F.regexp_extract("path", r"([0-9]+)\.seg$", 1).try_cast("bigint").alias("segment_id"))
        return self.index().select("segment_id").distinct().join(there, "segment_id", "left_anti")

    # Working on its own.

    def work(self, stop: Event, every: float = 600.0, trigger: Event | None = None) -> None:
        """Evicts when triggered and compacts now and then until ``stop`` is set; meant for a thread of its own."""
        trigger = trigger or Event()
        last = time.monotonic()
        while not stop.is_set():
            if trigger.wait(min(every, 0.2)):
                trigger.clear()
                self.evict()
            elif time.monotonic() - last >= every:
                self.compact()
                last = time.monotonic()

    def ingest(self, stream: DataFrame, checkpoint: str):
        """A streaming query that puts every micro-batch of (key, value) rows."""
        return stream.writeStream.foreachBatch(lambda batch, _: self.put(batch)).option("checkpointLocation", checkpoint).start()

    def _check_open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")


def _tasks(entries: DataFrame) -> int:
    """Tasks that read entries, each about as much as a part has."""
    return (entries.agg(F.sum("physical_size")).first()[0] or 0) // C.PART_BYTES + 1


def _numbered(found: DataFrame, start: int) -> DataFrame:
    """Log rows of records: put in the order of segments and positions, which is dealt by stretches of a segment."""
    dealt = found.withColumn("stretch", F.floor(F.col("pos") / C.PART_BYTES))
    order = running(dealt, ["segment_id", "stretch"], [F.col("pos"), F.col("hash")], {"n": F.lit(1)})
    return order.select((F.lit(start) + F.col("n")).alias("seq"), F.lit("put").alias("kind"), F.col("hash").alias("key_hash"), "segment_id", "pos", F.col("logical_size").alias("size"), "flags")


def recover(spark: SparkSession, path: str, config: C.StoreConfig | None = None) -> dict[str, int]:
    """Rebuilds the index log of a store from its segment files; files that cannot be read are counted and stay.

    The new log is written beside the old one and takes its place only when it is whole.
    """
    path, config = path.rstrip("/"), config or C.StoreConfig()
    fs, at = file_system(spark, f"{path}/segments")
    if not fs.exists(at):
        raise FileNotFoundError(f"no segments under {path}")
    files = segfile.scan_files(spark, f"{path}/segments")
    status = {r.status: r["count"] for r in segfile.footers(files).groupBy("status").count().collect()}
    found = segfile.recovered_index(files)
    top = (found.agg(F.max("segment_id")).first()[0] or 0) >> _BATCH_BITS  # numbers go on after those of the files
    rows = _numbered(found, top + 1 << _BATCH_BITS)
    fresh = f"{path}/index.new"
    drop(spark, fresh)
    rows.write.parquet(f"{fresh}/{top + 1:012d}")
    n = spark.read.parquet(f"{fresh}/{top + 1:012d}").count()
    drop(spark, f"{path}/index")
    fs.rename(file_system(spark, fresh)[1], file_system(spark, f"{path}/index")[1])
    fs.create(file_system(spark, f"{path}/.initialized")[1], True).close()
    return {"valid": status.get("valid", 0), "corrupt": status.get("corrupt", 0), "recovered": n}
