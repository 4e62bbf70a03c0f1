"""Keyed put, get, overlay and verification over blob tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise.functions import columns as K


def newest(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The newest row of each key: an aggregate with partial maxima, so a key written most is no bottleneck."""
    best = F.max_by(F.struct(*keep), F.struct(*order)).alias("__n")
    return df.groupBy(key).agg(best).select(key, "__n.*")


def put(table: DataFrame, batch: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The table after a batch of puts: the newest version of each key; sizes count that version only."""
    cols = [c for c in table.columns if c != key]
    return newest(table.unionByName(batch.select(*table.columns)), key, [order], cols).select(*table.columns)


def make_entry(df: DataFrame, supplied: Column, size: Column, *, value: Column | None = None) -> DataFrame:
    """Flags of new entries: a checksum that the caller supplies comes first, then one made of the value, else none."""
    made = F.coalesce(supplied, F.crc32(value)) if value is not None else supplied
    return df.select("*", K.pack_flags(made, F.lit(False), F.lit(0)).alias("flags"), size.alias("logical_size"))


def get(requests: DataFrame, table: DataFrame, key: str = "key") -> DataFrame:
    """One row per request, with ``found``; the planner broadcasts whichever side is small."""
    marked = table.withColumn("__f", F.lit(True))
    return requests.join(marked, key, "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__f")


def view(found: DataFrame, fn: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """A caller's function over matched rows, in pandas batches."""
    return found.where("found").mapInPandas(fn, schema)


def overlay(layers: DataFrame, key: str = "key", layer: str = "layer", order: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Per key the row of the first layer that has it, newest first inside a layer (``order`` ascends)."""
    keep = keep or [c for c in layers.columns if c != key]
    first = F.struct(F.negate(layer).alias("l"), *(order or []))
    return layers.groupBy(key).agg(F.max_by(F.struct(*keep), first).alias("__o")).select(key, "__o.*")


def verified(df: DataFrame, value: Column, checksum: Column) -> DataFrame:
    """df with ``verified``: whether the value's CRC32 is the one kept; null where none is kept."""
    return df.withColumn("verified", F.when(checksum.isNotNull(), F.crc32(value) == checksum))


def verify_or_fail(df: DataFrame, value: Column, checksum: Column) -> DataFrame:
    """df, failing the job at the first value that does not match."""
    wrong = checksum.isNotNull() & (F.crc32(value) != checksum)
    return df.where(F.when(wrong, F.raise_error(F.lit("checksum mismatch")).cast("boolean")).otherwise(True))


def visited(index: DataFrame, reads: DataFrame, key: str = "key") -> DataFrame:
    """index with ``visited``: whether the key was read from the index tier."""
    marks = reads.select(key).distinct().withColumn("__v", F.lit(True))
    return index.join(marks, key, "left").withColumn("visited", F.coalesce("__v", F.lit(False))).drop("__v")


def self_heal(index: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """index without the entries whose blobs are gone for good."""
    return index.join(missing, key, "left_anti")
