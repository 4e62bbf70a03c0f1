"""Placing blobs in slabs, segments and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from slabwise import config as C
from slabwise.functions import columns as K
from slabwise.tables import bounded_batches


def offsets(df: DataFrame, group: list[str], order: list[str], size: str = "size", name: str = "pos") -> DataFrame:
    """df with the sum of the sizes before each row of its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def slab_layout(df: DataFrame, segment: str, slab: str, order: list[str], size: str = "size") -> DataFrame:
    """df with absolute positions: slabs start on pages, blobs follow one another inside."""
    inner = offsets(df, [segment, slab], order, size, "__in")
    slabs = df.groupBy(segment, slab).agg(K.page_round(F.sum(size)).alias("__bytes"))
    starts = offsets(slabs, [segment], [slab], "__bytes", "__start").select(segment, slab, "__start")
    return inner.join(starts, [segment, slab]).withColumn("pos", F.col("__start") + F.col("__in")).drop("__in", "__start")


def route(size: Column, threshold: int) -> Column:
    """Blobs over the threshold go to a batch of their own."""
    return F.when(size > threshold, F.lit("large")).otherwise(F.lit("slab"))


def large_slabs(df: DataFrame, writer: str, order: list[str]) -> DataFrame:
    """df with a slab of its own for each blob: negative numbers, apart from those of packed slabs."""
    return df.withColumn("slab", -F.row_number().over(Window.partitionBy(writer).orderBy(*order)).cast("long"))


def segment_ids(segment: Column, writer: Column, start: int, writers: int) -> Column:
    """Numbers of the segments that ``writers`` open side by side, from ``start`` on: none twice, later ones larger."""
    return F.lit(start) + segment * writers + writer


def segment_records(chunks: DataFrame, segment: str, chunk: str, order: list[str], keep: list[str]) -> DataFrame:
    """(segment, records): each segment's records put together from its chunks, in their order."""
    rows = F.array_sort(F.collect_list(F.struct(chunk, *order, *(c for c in keep if c not in order))))
    return chunks.groupBy(segment).agg(F.transform(rows, lambda r: F.struct(*(r[c].alias(c) for c in keep))).alias("records"))


def chunked(df: DataFrame, segment: str, order: list[str], limit: int = C.CHUNK_RECORDS) -> DataFrame:
    """df with the chunk that each record of a segment is written in."""
    w = Window.partitionBy(segment).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / limit).cast("long"))


def packed(df: DataFrame, writer: str, order: list[str], slab_bytes: int, size: str = "size", at: str | None = None) -> DataFrame:
    """df with the slab of its writer that each blob falls in: the next one once a blob does not fit. ``at`` names a
    column for its place in the slab.

    Next-fit is sequential per writer; only (writer, order, size) travel, streamed in order, so that the state is two
    numbers whatever a writer holds.
    """
    cols = [writer, *order, size]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, end, slab = None, 0, 0
        for f in frames:
            slabs, begins = [], []
            for w, n in zip(f[writer], f[size], strict=True):
                if w != who:
                    who, end, slab = w, 0, 0
                elif end + n > slab_bytes:
                    end, slab = 0, slab + 1
                begins.append(end)
                end += n
                slabs.append(slab)
            more = {"slab": slabs} | ({at: begins} if at else {})
            yield f.assign(**{c: pd.Series(x, index=f.index, dtype="int64") for c, x in more.items()})

    bounded_batches(df.sparkSession)
    sorted_rows = df.select(*cols).repartition(writer).sortWithinPartitions(writer, *order)
    return sorted_rows.mapInPandas(fold, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", slab long" + (f", {at} long" if at else ""))


def rotated(slabs: DataFrame, writer: str, segment_bytes: int, size: str = "bytes", at: tuple[str, str] | None = None) -> DataFrame:
    """(writer, slab, segment): a new segment once a slab's end reaches ``segment_bytes``; slabs take whole pages.
    ``at`` names two columns for where a slab begins and ends in its segment."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, end, segment = None, 0, 0
        for f in frames:
            out, begins, ends = [], [], []
            for w, n in zip(f[writer], f[size], strict=True):
                if w != who:
                    who, end, segment = w, 0, 0
                out.append(segment)
                begins.append(end)
                end += -(-n // C.PAGE) * C.PAGE
                ends.append(end)
                if end >= segment_bytes:
                    end, segment = 0, segment + 1
            more = {"segment": out} | ({at[0]: begins, at[1]: ends} if at else {})
            yield f[[writer, "slab"]].assign(**{c: pd.Series(x, index=f.index, dtype="int64") for c, x in more.items()})

    bounded_batches(slabs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in slabs.schema}
    return slabs.select(writer, "slab", size).repartition(writer).sortWithinPartitions(writer, "slab").mapInPandas(fold, f"{writer} {kinds[writer]}, slab long, segment long" + (f", {at[0]} long, {at[1]} long" if at else ""))
