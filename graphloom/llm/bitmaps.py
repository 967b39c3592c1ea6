"""Bitmaps of fixed size, put together by the executors, for filters that are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_CHUNK = 1 << 15  # bits of one row while a bitmap is put together


def bitmap(positions: DataFrame, size: int) -> bytes:
    """``size`` bits, those at the positions ``at`` (0 to size - 1) set. At most size / 8 bytes come to the driver."""
    chunks = positions.select("at").groupBy(F.floor(F.col("at") / _CHUNK).cast("bigint").alias("chunk")).agg(F.expr(f"bitmap_construct_agg(at % {_CHUNK})").alias("bits"))
    out = bytearray(size >> 3)
    for row in chunks.collect():  # at most size / _CHUNK rows of 4 KB
        start = row.chunk * (_CHUNK >> 3)
        part = bytes(row.bits)[: _CHUNK >> 3]
        out[start : start + len(part)] = part
    return bytes(out)


def has(bits: bytes, at: int) -> bool:
    """Whether the bit at a position is set."""
    return bool(bits[at >> 3] >> (at & 7) & 1)
