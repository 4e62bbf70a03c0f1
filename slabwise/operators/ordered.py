"""Running sums, numbering and last values along a total order without gathering it in one task.

The order is cut into buckets (a prefix of it). Windows work inside a bucket; what the buckets before add up to comes
from a table with one row a bucket, the only one that is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def running(df: DataFrame, bucket: list[str], order: list[Column], sums: dict[str, Column], coarse: Column | None = None) -> DataFrame:
    """df with, for each name in ``sums``, the sum of its column over all rows before (exclusive).

    ``bucket`` columns come first in the order, then ``order`` inside a bucket; together they are a total order.
    ``coarse`` puts neighbouring buckets together, in their order: then only its groups are ordered as a whole, which
    keeps that one task small where there are many buckets.
    """
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*bucket).agg(*(F.sum(c).alias(f"__t_{n}") for n, c in sums.items()))
    if coarse is None:
        across = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*bucket, *(F.coalesce(F.sum(f"__t_{n}").over(across), F.lit(0)).alias(f"__b_{n}") for n in sums))
    else:
        grouped = totals.withColumn("__coarse", coarse)
        before = running(grouped, ["__coarse"], [F.col(c) for c in bucket], {f"__b_{n}": F.col(f"__t_{n}") for n in sums}).select(*bucket, *(f"__b_{n}" for n in sums))
    local = df.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__l_{n}") for n, c in sums.items()))
    joined = local.join(before, bucket)
    return joined.select(*df.columns, *((F.col(f"__l_{n}") + F.col(f"__b_{n}")).alias(n) for n in sums))


def last_before(df: DataFrame, key: str, bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the last non-null ``value`` of the key up to each row; a key with most rows is dealt by bucket."""
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = df.withColumn("__v", value)
    ends = known.groupBy(key, bucket).agg(F.max(F.when(F.col("__v").isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("__v").alias("v")))).alias("__e"))
    across = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, bucket, F.last("__e.v", ignorenulls=True).over(across).alias("__c"))
    out = known.withColumn("__i", F.last("__v", ignorenulls=True).over(inside)).join(carried, [key, bucket])
    return out.withColumn(name, F.coalesce("__i", "__c")).drop("__v", "__i", "__c")
