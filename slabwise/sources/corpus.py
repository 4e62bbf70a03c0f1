"""Corpora: the driver's tables as blobs, index and operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_DOCS, CHUNK_DOCS = 50, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, seq, size, text): documents as blobs; sizes in bytes."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"), F.col("doc_id").alias("seq"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce("text", F.lit("")).alias("text"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the document corpus: where each blob lies and its marks. The text itself is not kept."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(i, F.floor(i / SEGMENT_DOCS).cast("long").alias("segment_id"), F.floor(i % SEGMENT_DOCS / CHUNK_DOCS).cast("long").alias("chunk"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), (i % 11 == 0).alias("deleted"), (i % 3 == 0).alias("visited"), i.alias("ingest_seq"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, hour, op, key, size): the event log as puts and gets, in the order of (ts, seq)."""
    return as_ops(table(spark, sf_dir, "events"))


def as_ops(events: DataFrame) -> DataFrame:
    put = F.col("event_type").isin("purchase", "signup")
    key = F.when(F.col("event_type") == "error", F.concat(F.lit("miss-"), F.col("event_id"))).otherwise(F.concat(F.lit("u-"), F.col("user_id")))
    return events.select(F.col("event_id").alias("seq"), "ts", F.date_trunc("hour", "ts").alias("hour"), F.when(put, F.lit("put")).otherwise(F.lit("get")).alias("op"), key.alias("key"), F.when(put, F.floor(F.col("value") * 1000).cast("long")).alias("size"))


def generated_workload(spark: SparkSession, n: int, *, put_share: float = 0.10, hit_share: float = 0.45, size: int = 1 << 20, seed: int = 42) -> DataFrame:
    """(seq, op, key, size): a seeded mix of puts of new keys, gets of keys put before and gets of absent keys."""
    draw = spark.range(n).select(F.col("id").alias("seq"), F.rand(seed).alias("r"), F.rand(seed + 1).alias("p"))
    op = F.when(F.col("r") < put_share, F.lit("put")).otherwise(F.lit("get"))
    own = F.floor(F.col("p") * F.greatest(F.col("seq"), F.lit(1)))
    key = F.when(F.col("r") < put_share, F.concat(F.lit("key-"), F.col("seq"))).when(F.col("r") < put_share + hit_share, F.concat(F.lit("key-"), own)).otherwise(F.concat(F.lit("miss-"), F.col("seq")))
    return draw.select("seq", op.alias("op"), key.alias("key"), F.when(F.col("r") < put_share, F.lit(size).cast("long")).alias("size"))
