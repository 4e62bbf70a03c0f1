"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.tables import BATCH_BYTES, bounded_batches, release, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else, unlike ``lower``."""
    return F.translate(c, UPPER, LOWER)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Words of digits, ASCII letters in lower case and all non-ASCII characters."""
    return raw.translate(_WORD_BYTES).split() if raw else []


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, rows: int) -> DataFrame:
    """(id, text, y) of labelled training documents, at most ``rows``: those whose id has the smallest hash.

    The bound makes the broadcast side bounded; scoring and statistics elsewhere cover all documents.
    """
    own = labels.select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & train)
    picked = own.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(picked), "id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression with an intercept as the last one, by damped Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, c = np.zeros(a.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (c * p * (1 - p))[:, None]).T @ a / c.sum() + (l2 + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (c * (y - p)) / c.sum() - l2 * w)
        w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w
