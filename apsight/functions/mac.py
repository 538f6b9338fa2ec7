"""BSSID / MAC-address column expressions (all built-in, codegen-friendly).

A BSSID is normalised (trim, upper, '-' -> ':'), split on ':' and the first
octet parsed as base 16. Its two low bits are the multicast (1) and local (2)
flags, so ``value & 3`` *is* the flags code. A registry key is the first
octet formatted as at least two upper-case hex digits followed by the second
and third parts exactly as written (they are not re-padded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX_RE = "^[0-9A-F]{1,15}$"


def normalize_bssid(c: Column) -> Column:
    return F.translate(F.upper(F.trim(c)), "-", ":")


def octets(c: Column) -> Column:
    """Array of ':'-separated parts of the normalised BSSID."""
    return F.split(normalize_bssid(c), ":")


def hex2(v: Column) -> Column:
    """``%02X``: upper-case hex, left-padded to two digits, never truncated."""
    h = F.hex(v)
    return F.when(F.length(h) < 2, F.lpad(h, 2, "0")).otherwise(h)


def parse_hex(s: Column) -> Column:
    """Base-16 text to a number; null unless the text is plain hex.

    ``conv`` turns junk into '0', so the text is checked first.
    """
    return F.when(s.rlike(HEX_RE), F.conv(s, 16, 10).cast("long"))


def _pad2(part: Column) -> Column:
    return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)


def _fields(parts: Column, first: Column, pad_octets: bool) -> dict[str, Column]:
    short = F.size(parts) < 3
    bad = (~short) & first.isNull()
    p1, p2 = F.get(parts, 1), F.get(parts, 2)
    if pad_octets:
        p1, p2 = _pad2(p1), _pad2(p2)
    return {
        "short": short,
        "bad": bad,
        "first": first,
        "mac_flags": F.when(short | bad, F.lit(0)).otherwise(first.bitwiseAND(3).cast("int")),
        "base_key": F.when(~short & ~bad, F.concat_ws("-", hex2(first.bitwiseAND(-4)), p1, p2)),
        "low_bits": first.bitwiseAND(3).cast("int"),
    }


def mac_fields(bssid: Column, pad_octets: bool = False) -> dict[str, Column]:
    """Column expressions derived from a raw BSSID column.

    Keys: ``short`` (fewer than 3 parts), ``bad`` (3+ parts, first octet not
    hex), ``first`` (octet value), ``mac_flags``, ``base_key`` (registry key
    with the two flag bits cleared) and ``low_bits``. The second and third
    parts are used as written; ``pad_octets=True`` left-pads them to two digits
    for inputs that drop leading zeros (an option, off by default).
    """
    parts = octets(bssid)
    return _fields(parts, parse_hex(F.get(parts, 0)), pad_octets)


def with_mac_fields(df: DataFrame, bssid: str, pad_octets: bool = False, **names: str) -> DataFrame:
    """``df`` with the fields of ``mac_fields`` that ``names`` lists (field=column name).

    The BSSID is split and its first octet parsed in projections of their own,
    once a row, however many fields refer to them.
    """
    parts = df.select("*", F.split(normalize_bssid(F.col(bssid)), ":", 4).alias("_parts"))
    parsed = parts.select("*", parse_hex(F.get("_parts", F.lit(0))).alias("_first"))
    fields = _fields(F.col("_parts"), F.col("_first"), pad_octets)
    return parsed.select(*[df[c] for c in df.columns], *[fields[f].alias(c) for f, c in names.items()])


def oui_key(bssid: Column, flip_mask: int = 0) -> Column:
    """Registry key of a BSSID after XOR-ing the first octet with ``flip_mask``."""
    parts = octets(bssid)
    first = parse_hex(F.get(parts, 0))
    return F.concat_ws("-", hex2(first.bitwiseXOR(flip_mask)), F.get(parts, 1), F.get(parts, 2))
