"""Structured Streaming ingest and SIEVE replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.functions import columns as K
from slabwise.operators.evict import SieveList
from slabwise.sources.corpus import as_ops


def ingest(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_trigger: int = 8) -> None:
    """Event files to an operation table. A batch writes its own folder, so that one run twice replaces itself."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def sink(batch: DataFrame, batch_id: int) -> None:
        as_ops(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def totals(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def sieve_replay(ops: DataFrame, max_size: int, shards: int, every: int = 1) -> DataFrame:
    """(shard, seq, victim): evictions of a log with puts and gets in between, each key in a shard with its share of
    ``max_size``. The policy is sequential in a shard; its rows stream in order and only live keys are held."""
    share = max_size // shards
    dealt = ops.select(F.pmod(K.portable_hash(F.col("key")), F.lit(shards)).cast("int").alias("shard"), "ts", "seq", "op", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, policy, puts = None, SieveList(), 0
        for f in frames:
            out = []
            for s, seq, op, key, size in zip(f.shard, f.seq, f.op, f["key"], f["size"], strict=True):
                if s != shard:
                    shard, policy, puts = s, SieveList(), 0
                if op == "get":
                    policy.read(key)
                    continue
                policy.put(key, int(size))
                puts += 1
                if puts % every == 0:
                    out += [(s, seq, v) for v in policy.shrink(share)]
            yield pd.DataFrame(out, columns=["shard", "seq", "victim"])

    return dealt.repartition("shard").sortWithinPartitions("shard", "ts", "seq").mapInPandas(run, "shard int, seq long, victim string")


class _Nodes:
    """Nodes (size, bit, before, after) of a map state, read when they are asked for and written back when the batch
    is done. Beside a key stands "k", so that the ends of the list are the empty key."""

    def __init__(self, state) -> None:
        self.state, self.held = state, {}

    def of(self, key) -> list | None:
        if key not in self.held:
            at = ("" if key is None else f"k{key}",)
            self.held[key] = list(self.state.getValue(at)) if self.state.containsKey(at) else [0, False, None, None] if key is None else None
        return self.held[key]

    def save(self) -> None:
        for key, node in self.held.items():
            at = ("" if key is None else f"k{key}",)
            if node is not None:
                self.state.updateValue(at, tuple(node))
            elif self.state.containsKey(at):
                self.state.removeKey(at)


class _Field:
    """One field of all nodes as a mapping."""

    def __init__(self, nodes: _Nodes, at: int) -> None:
        self.nodes, self.at = nodes, at

    def __contains__(self, key) -> bool:
        return self.nodes.of(key) is not None

    def __getitem__(self, key):
        return self.nodes.of(key)[self.at]

    def __setitem__(self, key, value) -> None:
        node = self.nodes.of(key)
        if node is None:
            node = self.nodes.held[key] = [0, False, None, None]
        node[self.at] = value

    def pop(self, key):
        return self[key]

    def __delitem__(self, key) -> None:
        self.nodes.held[key] = None


def sieve_state_processor(max_size: int):
    """A stateful processor for streams grouped by shard. The policy's nodes are a map state, of which a batch reads
    and writes only those that it touches."""
    from pyspark.sql.streaming import StatefulProcessor

    class Sieve(StatefulProcessor):
        def init(self, handle) -> None:
            self.nodes = handle.getMapState("nodes", "key string", "size long, bit boolean, before string, after string")
            self.rest = handle.getValueState("rest", "hand string, total long")

        def handleInputRows(self, key, rows, timer_values):  # noqa: N802
            policy, nodes = SieveList(), _Nodes(self.nodes)
            policy.size, policy.bit, policy.before, policy.after = (_Field(nodes, i) for i in range(4))
            if self.rest.exists():
                policy.hand, policy.total = self.rest.get()
            out = []
            for f in rows:
                for r in f.sort_values(["ts", "seq"]).itertuples():
                    if r.op == "get":
                        policy.read(r.key)
                    else:
                        policy.put(r.key, int(r.size))
                        out += [(key[0], r.seq, v) for v in policy.shrink(max_size)]
            nodes.save()
            self.rest.update((policy.hand, policy.total))
            yield pd.DataFrame(out, columns=["shard", "seq", "victim"])

        def close(self) -> None:
            pass

    return Sieve()


def sieve_stream(ops: DataFrame, max_size: int) -> DataFrame:
    """(shard, seq, victim) of a streaming log with column shard; needs a state store that keeps large states."""
    return ops.groupBy("shard").transformWithStateInPandas(sieve_state_processor(max_size), "shard int, seq long, victim string", "append", "none")
