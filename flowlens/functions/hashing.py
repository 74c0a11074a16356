"""Seeded, partitioning-independent pseudo-random draws.

``rand(seed)`` depends on how rows are partitioned, so reproducible sampling uses a hash of
the draw's coordinates instead: the first 60 bits of md5 over the '|'-joined parts, as a bigint.
The same number is available in DuckDB as ('0x' || substr(md5(...), 1, 15))::BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts) -> Column:
    """Column form: parts are Columns or Python literals."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """SQL-text form, for use inside higher-order-function lambdas. Parts are SQL expressions."""
    inner = ", ".join(f"cast({p} as string)" for p in parts)
    return f"cast(conv(substr(md5(concat_ws('|', {inner})), 1, 15), 16, 10) as bigint)"
