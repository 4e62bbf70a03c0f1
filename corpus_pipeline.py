"""Corpus pipeline: from raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabwise.llm import decontaminate, line_dedup, packing, quality, simhash_dedup
from slabwise.llm.common import held_out, release, table, written

#: Not expressible in SQL: the quality model is fitted and the near copies are transitive.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go.

    Null texts score as empty ones; equal texts stay or go together; rows and columns that stay are as they were.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id", 3, 1))
    return quality.good_documents(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: of a line in ten documents or more, the first stays.

    Every row stays, with what is left of its text and its new length; null texts become empty ones. Rows that share
    an id are one document when documents are counted, null ids too. Other columns are as they were.
    """
    done = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True, counts=False)
    return _measured(done, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, every link confirmed by shared shingles: one row of each group stays, one with the smallest
    id.

    Texts without words are alike, null ones too; a null id is larger than others; of rows that repeat one stays. The
    row that stays is as it was.
    """
    return simhash_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: long benchmark passages go, and documents that they cover too much.

    Null and empty texts stay; repeated rows are cut or go together; lengths are those of what is left; other columns
    are as they were.
    """
    done = decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))
    return _measured(done, docs.columns)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the lengths of their texts as they are now, if they have a column for it."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every row's bucket, batch and slot.

    Null texts have no tokens; repeated rows and null ids get slots of their own; other columns are not read.
    """
    return packing.pack(docs, packing.word_count(docs.text))


STAGES = [("quality", keep_good), ("line_dedup", dedup_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
