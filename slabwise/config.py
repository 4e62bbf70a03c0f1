"""Store options and fixed format values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: sizes in bytes, flag bits, rates.
SEGMENT_MAGIC = 0xB10BCA4EB10BCA4E
RECORD_BYTES, HEADER_BYTES, FOOTER_BYTES = 40, 16, 20
PAGE = 4096
PART_BYTES = 64 << 20  # of a segment's data in a file; longer segments have several
NO_CHECKSUM_BIT, DELETED_BIT, CODEC_SHIFT = 32, 33, 60
CODECS = ("none", "zstd", "lz4", "s2")
CHUNK_RECORDS = (65536 - HEADER_BYTES) // RECORD_BYTES
HYSTERESIS_PERCENT = 95
BLOOM_BLOCK_BITS, BLOOM_PAD = 512, 1.15
REBUILD_DELETED_SHARE, REBUILD_FPR_FACTOR, REBUILD_MIN_HITS = 0.10, 5.0, 2000
COMPACT_BELOW, COMPACT_PER_CYCLE = 0.20, 2
TRANSIENT_ERRORS = ("EINTR", "EAGAIN", "EBUSY", "EMFILE", "ENFILE", "ENOMEM", "ETIMEDOUT")


@dataclass(frozen=True)
class StoreConfig:
    """Options of a store; sizes in bytes."""

    max_size: int = 0  # 0: no eviction
    shards: int = 1
    slab_bytes: int = 128 << 20
    large_threshold: int = 4 << 20
    segment_bytes: int = 2 << 30
    degraded_keep_batches: int = 6
    flush_concurrency: int = 6
    bloom_fp_rate: float = 0.01
    bloom_keys: int = 1_000_000
    checksum: bool = False
    verify: bool = False
    policy: str = "sieve"
    key_hash: Callable[[Column], Column] = F.xxhash64  # of the key, to a long
    checksum_of: Callable[[Column], Column] | None = None  # of the value, to 32 bits; CRC32 without

    def __post_init__(self) -> None:
        if self.policy not in ("sieve", "fifo"):
            raise ValueError(f"unknown policy {self.policy}")
        if self.shards < 1 or self.max_size < 0 or self.flush_concurrency < 1:
            raise ValueError("shards and flush_concurrency must be 1 or more and max_size 0 or more")
        if not 0 < self.bloom_fp_rate < 1 or self.bloom_keys < 0:
            raise ValueError("bloom_fp_rate must be between 0 and 1 and bloom_keys 0 or more")
