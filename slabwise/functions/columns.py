"""Scalar column functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from slabwise import config as C

_U32 = 0xFFFFFFFF


def portable_hash(key: Column) -> Column:
    """60 bits of MD5: the same non-negative value in any SQL engine."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def xxh64_seed0(key: Column) -> Column:
    """XXH64 with seed 0, for stores whose keys were hashed so; needs Python."""
    import xxhash

    def hashed(keys: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else xxhash.xxh64_intdigest(bytes(k)) - (1 << 64) * (xxhash.xxh64_intdigest(bytes(k)) >> 63) for k in keys], dtype="Int64")

    return F.pandas_udf(hashed, "long")(key.cast("binary"))


def pack_flags(checksum: Column, deleted: Column, codec: Column) -> Column:
    """checksum: bits 0-31, null means none (bit 32); deleted: bit 33; codec: bits 60-63."""
    sum_bits = F.when(checksum.isNull(), F.lit(1 << C.NO_CHECKSUM_BIT)).otherwise(checksum.bitwiseAND(F.lit(_U32)))
    return sum_bits.bitwiseOR(F.when(deleted, F.lit(1 << C.DELETED_BIT)).otherwise(F.lit(0).cast("long"))).bitwiseOR(F.shiftleft(codec.cast("long"), C.CODEC_SHIFT))


def has_checksum(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1 << C.NO_CHECKSUM_BIT)) == 0


def checksum(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(_U32))


def is_deleted(flags: Column) -> Column:
    return flags.bitwiseAND(F.lit(1 << C.DELETED_BIT)) != 0


def set_deleted(flags: Column) -> Column:
    return flags.bitwiseOR(F.lit(1 << C.DELETED_BIT))


def codec(flags: Column) -> Column:
    return F.shiftrightunsigned(flags, C.CODEC_SHIFT).bitwiseAND(F.lit(15).cast("long"))


def set_codec(flags: Column, value: Column) -> Column:
    return flags.bitwiseAND(F.lit((1 << C.CODEC_SHIFT) - 1)).bitwiseOR(F.shiftleft(value.cast("long"), C.CODEC_SHIFT))


def compression_ratio(logical: Column, physical: Column) -> Column:
    return F.when(logical == 0, F.lit(0.0)).otherwise(physical / logical)


def chosen_codec(logical: Column, physical: Column, name: str = "zstd") -> Column:
    """A codec is kept only if it saves an eighth or more."""
    return F.when(physical * 8 <= logical * 7, F.lit(name)).otherwise(F.lit("none"))


def page_round(n: Column) -> Column:
    return (n + (C.PAGE - 1)).bitwiseAND(F.lit(~(C.PAGE - 1)).cast("long"))


def metadata_bytes(records: Column) -> Column:
    return page_round(records * C.RECORD_BYTES + (C.HEADER_BYTES + C.FOOTER_BYTES))


def punchable(pos: Column, size: Column) -> Column:
    """(off, len, can_punch): the whole pages inside a blob."""
    off = page_round(pos)
    rest = size - (off - pos)
    can = rest >= C.PAGE
    whole = rest.bitwiseAND(F.lit(~(C.PAGE - 1)).cast("long"))
    zero = F.lit(0).cast("long")
    return F.struct(F.when(can, off).otherwise(zero).alias("off"), F.when(can, whole).otherwise(zero).alias("len"), can.alias("can_punch"))


def segment_path(segment_id: Column, shards: int, base: str = "") -> Column:
    return F.concat(F.lit(f"{base}/" if base else ""), F.format_string("segments/%04d/%d.seg", F.pmod(segment_id, F.lit(max(1, shards))), segment_id))


def chunk_key(segment_id: Column, chunk: Column) -> Column:
    """16 bytes that sort as (segment, chunk) do for numbers of 0 or more: both big-endian."""
    big = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))
    return F.concat(big(segment_id), big(chunk))


def chunk_of_key(key: Column) -> Column:
    """(segment_id, chunk) of a chunk's key."""
    number = lambda at: F.conv(F.hex(F.substring(key, at, 8)), 16, -10).cast("long")
    return F.struct(number(1).alias("segment_id"), number(9).alias("chunk"))


def segment_id_of(name: Column) -> Column:
    """The number that a segment's file name starts with; 0 if there is none that fits."""
    return F.coalesce(F.regexp_extract(name, r"^([+-]?[0-9]{1,18})", 1).try_cast("bigint"), F.lit(0).cast("long"))


def is_transient(code: Column) -> Column:
    return F.coalesce(code.isin(*C.TRANSIENT_ERRORS), F.lit(False))


def slab_slots(slab_bytes: int) -> int:
    """Index slots of a slab: one for 8 KB, within 4,096 and 2^20."""
    return min(1 << 20, max(4096, slab_bytes // 8192))
