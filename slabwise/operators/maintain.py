"""Deleting, repacking, compacting and summing up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabwise import config as C
from slabwise.operators.layout import chunked


def delete(index: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return index.join(doomed, keys, "left_anti")


def delete_by_segment(doomed: DataFrame, segment: str = "segment_id") -> DataFrame:
    return doomed.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.sum("size").cast("long").alias("bytes"))


def repack(index: DataFrame, doomed: DataFrame, keys: list[str], segment: str, order: list[str], limit: int = C.CHUNK_RECORDS) -> DataFrame:
    """(segment, chunk, n) after deletion: survivors in the fewest chunks, an empty chunk 0 where none survives."""
    left = delete(index, doomed, keys)
    full = chunked(left, segment, order, limit).groupBy(segment, "chunk").agg(F.count(F.lit(1)).alias("n"))
    empty = index.select(segment).distinct().join(left.select(segment), segment, "left_anti")
    return full.unionByName(empty.select(segment, F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("n")))


def stats(live: DataFrame, segment: str = "segment_id") -> DataFrame:
    per = live.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("blob_count"), F.count(F.lit(1)).alias("segment_count"))


def fullness(index: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Share of a segment's bytes that are live."""
    live = F.sum(F.when(~F.col("deleted"), F.col("size")).otherwise(0))
    total = F.sum("size")
    return index.groupBy(segment).agg(F.when(total == 0, F.lit(0.0)).otherwise(live / total).alias("fullness"))


def compaction_candidates(index: DataFrame, below: float = C.COMPACT_BELOW, cycle: int = C.COMPACT_PER_CYCLE, segment: str = "segment_id") -> DataFrame:
    """The emptiest segments under the threshold, as many as a cycle takes."""
    return fullness(index, segment).where(F.col("fullness") < below).orderBy("fullness", segment).limit(cycle).select(segment)


def first_error(log: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """The error that a store stays degraded by: the first."""
    return log.agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("e")).where("e IS NOT NULL").select("e.*")


def retained_batches(batches: DataFrame, batch: str, keep: int) -> DataFrame:
    """The newest batches that a degraded store keeps in memory."""
    newest = batches.select(batch).distinct().orderBy(F.desc(batch)).limit(keep)
    return batches.join(newest, batch, "left_semi")
