"""Choosing eviction victims in insertion order or by SIEVE.

One batch is a closed form: the order of victims is known without stepping, so that it is a sort and a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabwise import config as C
from slabwise.operators.ordered import running


def need(total: Column, max_size: Column) -> Column:
    """Bytes to free: down to 95% of the limit, and only once over it."""
    return F.when(total > max_size, total - F.floor(max_size * C.HYSTERESIS_PERCENT / 100)).otherwise(F.lit(0)).cast("long")


#: Buckets that one task orders; more are put together by the thousand first.
BUCKETS, WIDTH = 50_000, 1000


def limits(live: DataFrame, percent: int, bucket: str) -> DataFrame:
    """One row: total size, the bytes to free when the limit is ``percent`` of it, and how many buckets there may be."""
    total = F.sum("size").cast("long")
    limit = F.floor(total * percent / 100)
    return live.agg(total.alias("total"), need(total, limit).alias("need"), (F.max(bucket) - F.min(bucket) + 1).cast("long").alias("buckets"))


def _first(df: DataFrame, bucket: list[str], order: list[str], needed: int, buckets: int | None) -> DataFrame:
    many = buckets is None or buckets > BUCKETS
    coarse = F.struct(*bucket[:-1], F.floor(F.col(bucket[-1]) / WIDTH).alias("part")) if many else None
    placed = running(df, bucket, [F.col(c) for c in order], {"__before": F.col("size"), "ord": F.lit(1)}, coarse)
    return placed.where(F.col("__before") < needed).drop("__before").withColumn("ord", (F.col("ord") + 1).cast("long"))


def fifo(live: DataFrame, needed: int, bucket: str, pos: str, buckets: int | None = None) -> DataFrame:
    """Victims with ``ord`` from 1: the oldest until ``needed`` bytes are free. ``bucket`` is a number that does not
    fall along ``pos``; ``buckets``, if known, says how many there are at most."""
    return _first(live, [bucket], [pos], needed, buckets)


def sieve(live: DataFrame, needed: int, bucket: str, pos: str, hand: int | None, buckets: int | None = None) -> DataFrame:
    """Victims of one SIEVE batch with ``ord`` from 1: unvisited ones from the hand on and round, then the rest."""
    behind = F.lit(False) if hand is None else F.col(pos) < hand
    turned = live.withColumn("__late", F.col("visited").cast("int")).withColumn("__behind", behind.cast("int"))
    return _first(turned, ["__late", "__behind", bucket], [pos], needed, buckets).drop("__late", "__behind")


def sieve_after(live: DataFrame, victims: DataFrame, pos: str, hand: int | None) -> DataFrame:
    """Survivors with their visited bits after the batch, and ``is_hand``.

    If the last victim had been visited, the hand went all round and every bit is clear; else those that it passed.
    Without victims nothing changes.
    """
    last = victims.agg(F.max_by(F.struct(F.col(pos).alias("pos"), F.col("visited").alias("visited")), "ord").alias("v")).select("v.*").first()
    left = live.join(victims.select(pos), pos, "left_anti")
    if last is None or last.pos is None:
        return left.withColumn("is_hand", F.lit(False) if hand is None else F.col(pos) == hand)
    turn = lambda c: F.struct((F.lit(False) if hand is None else c < hand).alias("behind"), c.alias("pos"))
    bits = F.lit(False) if last.visited else F.col("visited") & ~(turn(F.col(pos)) < turn(F.lit(last.pos)))
    nxt = left.where(F.col(pos) > last.pos).agg(F.min(pos)).first()[0]
    return left.withColumn("visited", bits).withColumn("is_hand", F.lit(False) if nxt is None else F.col(pos) == nxt)


class SieveList:
    """The policy step by step, for replays in which puts and reads come between evictions. Keys are linked both ways,
    oldest first, so that every step but a turn of the hand takes constant time."""

    def __init__(self) -> None:
        self.size: dict = {}
        self.bit: dict = {}
        self.after: dict = {None: None}  # None is before the oldest and after the newest
        self.before: dict = {None: None}
        self.hand = None
        self.total = 0

    @property
    def order(self) -> list:
        out, key = [], self.after[None]
        while key is not None:
            out.append(key)
            key = self.after[key]
        return out

    def put(self, key, size: int) -> None:
        if key in self.size:
            self.drop(key)
        newest = self.before[None]
        self.after[newest], self.before[key], self.after[key], self.before[None] = key, newest, None, key
        self.size[key], self.bit[key] = size, False
        self.total += size

    def read(self, key) -> bool:
        if key in self.bit:
            self.bit[key] = True
            return True
        return False

    def drop(self, key) -> None:
        older, newer = self.before.pop(key), self.after.pop(key)
        self.after[older], self.before[newer] = newer, older
        if self.hand == key:
            self.hand = newer
        self.total -= self.size.pop(key)
        del self.bit[key]

    def evict(self):
        if self.after[None] is None:
            return None
        key = self.hand if self.hand is not None else self.after[None]
        while self.bit[key]:
            self.bit[key] = False
            key = self.after[key] if self.after[key] is not None else self.after[None]
        self.hand = key
        self.drop(key)
        return key

    def shrink(self, max_size: int) -> list:
        out = []
        if max_size and self.total > max_size:
            target = max_size * C.HYSTERESIS_PERCENT // 100
            while self.total > target and self.after[None] is not None:
                out.append(self.evict())
        return out
