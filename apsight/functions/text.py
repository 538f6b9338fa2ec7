"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_vendor(c: Column) -> Column:
    """null -> '', lower case, runs of white space -> one blank, trimmed.

    Collapse first and trim after: ``trim`` only strips blanks, while
    ``(?U)\\s`` also matches tabs, line breaks and Unicode spaces.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
