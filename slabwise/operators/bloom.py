"""Blocked Bloom filters as tables of words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise import config as C

_U32 = 0xFFFFFFFF


@dataclass(frozen=True)
class Geometry:
    bits: int
    probes: int
    blocks: int

    @staticmethod
    def of(keys: int, fp_rate: float) -> Geometry:
        raw = math.ceil(-keys * math.log(fp_rate) / (math.log(2) * math.log(2)))
        blocks = max(1, -(-int(raw * C.BLOOM_PAD) // C.BLOOM_BLOCK_BITS))
        return Geometry(blocks * C.BLOOM_BLOCK_BITS, max(1, math.ceil(-math.log2(fp_rate))), blocks)


def sizing(keys: Column, fp_rate: Column) -> list[Column]:
    """Columns bits, probes, blocks, bytes of a filter for ``keys`` at ``fp_rate``."""
    raw = F.ceil(-keys * F.log(fp_rate) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.floor(raw * C.BLOOM_PAD) / C.BLOOM_BLOCK_BITS).cast("long"))
    return [(blocks * C.BLOOM_BLOCK_BITS).alias("m"), F.greatest(F.lit(1).cast("long"), F.ceil(-F.log2(fp_rate))).alias("k"), blocks.alias("blocks"), (blocks * (C.BLOOM_BLOCK_BITS // 8)).alias("bytes")]


def probes(h: Column, g: Geometry) -> Column:
    """array<(word_idx, mask)> of a non-negative hash: one block, then steps of its rotated low half."""
    low = h.bitwiseAND(F.lit(_U32))
    block = F.shiftright(low * g.blocks, 32)
    delta = F.shiftright(low, 17).bitwiseOR(F.shiftleft(low, 15).bitwiseAND(F.lit(_U32)))

    def probe(i: Column) -> Column:
        bit = (low + i * delta).bitwiseAND(F.lit(C.BLOOM_BLOCK_BITS - 1).cast("long"))
        return F.struct((block * 16 + F.shiftright(bit, 5)).cast("int").alias("word_idx"), F.element_at(F.array(*(F.lit(1 << b) for b in range(32))).cast("array<bigint>"), (bit.bitwiseAND(F.lit(31).cast("long")) + 1).cast("int")).alias("mask"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(g.probes - 1).cast("long")), probe)


def build(hashes: DataFrame, h: str, g: Geometry) -> DataFrame:
    """(word_idx, word): an OR of masks with partial aggregates; at most bits / 32 rows leave a task."""
    each = hashes.select(F.explode(probes(F.col(h), g)).alias("p")).select("p.*")
    return each.groupBy("word_idx").agg(F.bit_or("mask").alias("word"))


def merge(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.groupBy("word_idx").agg(F.bit_or("word").alias("word"))


def test(keys: DataFrame, key: str, h: str, filter_: DataFrame, g: Geometry) -> DataFrame:
    """(key, maybe): whether all of a key's bits are set. The filter is joined by word, so it may be of any size."""
    each = keys.select(key, F.explode(probes(F.col(h), g)).alias("p")).select(key, "p.*")
    hit = F.coalesce(F.col("word").bitwiseAND(F.col("mask")) != 0, F.lit(False))
    return each.join(filter_, "word_idx", "left").groupBy(key).agg(F.bool_and(hit).alias("maybe"))


def rebuild_due(deleted: Column, keys: Column, hits: Column, ghosts: Column, fp_rate: float) -> list[Column]:
    """Columns stale, fpr_bad, rebuild of the counters since the last build."""
    stale = deleted > keys * C.REBUILD_DELETED_SHARE
    bad = (hits > C.REBUILD_MIN_HITS) & (ghosts / F.greatest(hits, F.lit(1)) > fp_rate * C.REBUILD_FPR_FACTOR)
    return [stale.alias("stale"), bad.alias("fpr_bad"), (stale | bad).alias("rebuild")]
