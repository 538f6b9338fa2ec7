"""Deterministic per-row hashing used for repeatable splits and samples.

``h = int(md5(key || '-' || salt)[0:8], 16)``: a 32-bit unsigned value that
DuckDB computes identically (``('0x' || substr(md5(..), 1, 8))::BIGINT``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def hash32(key: Column, salt: str | int) -> Column:
    text = F.concat(key.cast("string"), F.lit(f"-{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_hash(key: Column, salt: str | int) -> Column:
    """Hash mapped to [0, 1)."""
    return hash32(key, salt) / F.lit(float(HASH_SPACE))
