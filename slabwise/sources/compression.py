"""Value compression in Arrow batches of bounded bytes. Parquet's own codecs are the sink's way; these give explicit blobs."""

from __future__ import annotations

import zlib

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from slabwise.tables import bounded_batches

#: Levels by name for each codec; snappy, which s2 decoders read, has none.
LEVELS: dict[str, dict[str, int | None]] = {
    "zstd": {"default": 3, "speed": 1, "best": 11},
    "zlib": {"default": 6, "speed": 1, "best": 9},
    "lz4": {"default": 3, "speed": 3, "best": 9},
    "s2": {"default": None, "speed": None, "best": None},
}


class CodecError(ValueError):
    """An unknown codec or level."""


def _packer(codec: str, level: int | None):
    if codec == "zstd":
        return zstandard.ZstdCompressor(level=level).compress
    if codec == "zlib":
        return lambda b: zlib.compress(b, level)
    if codec == "lz4":
        packer = pa.Codec("lz4", compression_level=level)
        return lambda b: packer.compress(b, asbytes=True)
    return lambda b: pa.compress(b, "snappy", asbytes=True)


def _snappy_size(b: bytes) -> int:
    """The size that a block begins with, seven bits a byte."""
    size = 0
    for i, x in enumerate(b):
        size |= (x & 127) << 7 * i
        if x < 128:
            return size
    raise CodecError("no size in a block")


def _unpacker(codec: str):
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompress
    if codec == "zlib":
        return zlib.decompress
    if codec == "lz4":
        return lambda b: pa.CompressedInputStream(pa.BufferReader(b), "lz4").read()
    return lambda b: pa.decompress(b, _snappy_size(b), "snappy", asbytes=True)


def compress(value: Column, codec: str = "zstd", level: str = "default") -> Column:
    if codec not in LEVELS:
        raise CodecError(f"no codec {codec}")
    if level not in LEVELS[codec]:
        raise CodecError(f"no level {level}")
    n = LEVELS[codec][level]

    def run(values: pd.Series) -> pd.Series:
        pack = _packer(codec, n)
        return values.map(lambda b: None if b is None else pack(bytes(b)))

    bounded_batches(SparkSession.active())
    return F.pandas_udf(run, "binary")(value.cast("binary"))


def decompress(value: Column, codec: str = "zstd") -> Column:
    if codec not in LEVELS:
        raise CodecError(f"no codec {codec}")

    def run(values: pd.Series) -> pd.Series:
        unpack = _unpacker(codec)
        return values.map(lambda b: None if b is None else unpack(bytes(b)))

    bounded_batches(SparkSession.active())
    return F.pandas_udf(run, "binary")(value)
