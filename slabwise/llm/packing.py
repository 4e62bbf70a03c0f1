"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths finds the bucket boundaries with the least padding. Inside a
bucket, documents are numbered in the order of their ids without gathering them: rows are dealt by ranges of (bucket,
id) and keep their place in the range, and the counts of the ranges before a place give the number. Batches of a token
budget are cut from that numbering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from slabwise.llm.common import BLANKS, release, written

#: Bits of a row's number inside its partition, as monotonically_increasing_id has them.
_ROW_BITS = 33


def word_count(text: Column) -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def optimal_buckets(cells: list[tuple[int, int, int]], k: int) -> list[int]:
    """Upper bounds of at most ``k`` buckets with the least padding.

    ``cells`` has (longest, count, sum of lengths) in order of length. Exact: each step takes lower envelopes of
    lines, as the cost of ending a bucket at a cell is linear in the count before its start.
    """
    n = len(cells)
    if not n:
        return []
    count, total = [0] * (n + 1), [0] * (n + 1)
    for i, (_, c, s) in enumerate(cells):
        count[i + 1], total[i + 1] = count[i] + c, total[i] + s
    best: list[int | None] = [0] + [None] * n
    came: list[list[int]] = []
    for _ in range(min(k, n)):
        hull: list[tuple[int, int, int]] = []  # slope, offset, start; slopes fall
        at, new, frm = 0, [None] * (n + 1), [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                m, b = -count[i], best[i] + total[i]
                while len(hull) >= 2 and (b - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, b, i))
            at, x = min(at, len(hull) - 1), cells[j - 1][0]
            if not hull:
                continue
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], frm[j] = hull[at][0] * x + hull[at][1] + x * count[j] - total[j], hull[at][2]
        came.append(frm)
        if best[n] is not None and new[n] is not None and new[n] >= best[n]:
            came.pop()
            break
        best = new
    bounds, j = [], n
    for frm in reversed(came):
        bounds.append(cells[j - 1][0])
        j = frm[j]
    return bounds[::-1]


def pack(docs: DataFrame, length: Column, *, buckets: int = 16, budget: int = 16_384, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, bucket_id, bucket_len, batch_no, slot): one row per input row.

    A batch holds as many documents of its bucket as fit ``budget`` when padded to bucket_len, one at least; slot is
    the place in it, in the order of ids, null first, then lengths. Of equally good boundaries, those with fewer
    buckets and then the larger ones are taken. Documents without tokens are in the bucket of the shortest. Null ids
    are packed like others; repeated rows get slots of their own; columns besides ``id_col`` and those in ``length``
    are not read; an empty table gives no rows.

    The driver holds the histogram: k different lengths need k * k / 2 tokens at least, so 10^12 tokens have 1.4
    million at most.
    """
    size = F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("id"), size.alias("n")), "lengths")
    histogram = sorted((r.n, r.c) for r in sized.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect())
    bounds = optimal_buckets([(n, c, n * c) for n, c in histogram], buckets)
    cut = F.array(*(F.lit(b).cast("long") for b in bounds or [0]))
    bucket = sum(((F.col("n") > b).cast("int") for b in bounds[:-1]), F.lit(0))
    order = ["bucket", "id", "n"]
    dealt = sized.select("id", "n", bucket.alias("bucket"), F.monotonically_increasing_id().alias("u")).repartitionByRange(*order, "u").sortWithinPartitions(*order)
    placed = written(dealt.select("id", "n", "bucket", F.monotonically_increasing_id().alias("row")), "placed")
    release(sized)
    part = F.shiftright("row", _ROW_BITS).alias("part")
    ranges = placed.groupBy("bucket", part).agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("first"))  # buckets and partitions together, about
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("bucket", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    at = F.col("row") + F.col("shift")
    size = F.element_at(cut, F.col("bucket") + 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(size, F.lit(1).cast("long"))))
    joined = placed.withColumn("part", part).join(F.broadcast(ranges), ["bucket", "part"])
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("bucket").alias("bucket_id"), size.alias("bucket_len"), F.floor(at / room).alias("batch_no"), (at % room).cast("int").alias("slot"))
