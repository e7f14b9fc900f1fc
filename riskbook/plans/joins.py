"""Size-checked broadcast.

A dimension read from data is broadcast only if one plain aggregate over it
(rows and string bytes, map-side combined) proves it small; beyond the bound
the join stays a shuffle join.  The check belongs to the load step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest dimension broadcast after the check (estimated bytes in memory).
BROADCAST_MAX_BYTES = 64 << 20
# Bytes a row and a fixed-width value take besides string contents.
_ROW, _VALUE = 32, 16


def memory_bytes(df: DataFrame) -> int:
    """Estimated size of ``df`` in memory: one row moves per task."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    row = F.lit(_ROW + _VALUE * len(df.columns)).cast("long")
    for t in text:
        row = row + t
    return df.agg(F.sum(row).alias("n")).first()["n"] or 0


def bounded_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """``df`` with a broadcast hint if its estimated size is within the bound."""
    small = memory_bytes(df) <= max_bytes
    return (F.broadcast(df) if small else df), small
