"""Seeded, engine-independent row order.

Every fold, hold-out and sample is a function of ``(seed, row key)`` only:
``md5('<seed>:<key>')``.  The same hex string is produced by DuckDB, so the
assignments can be replayed in SQL, and re-partitioning the input cannot
change them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def seeded_key(seed, key: Column | str) -> Column:
    """Hex md5 of ``'<seed>:<key>'``; sorts as a seeded shuffle."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def seeded_key_sql(seed, key_sql: str) -> str:
    return f"md5('{seed}:' || CAST({key_sql} AS VARCHAR))"


def unit_uniform(hex_col: Column) -> Column:
    """First 32 bits of a hex digest as a double in [0, 1)."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def unit_uniform_sql(hex_sql: str) -> str:
    return f"(CAST(('0x' || substr({hex_sql}, 1, 8)) AS BIGINT) / CAST({TWO_POW_32} AS DOUBLE))"
