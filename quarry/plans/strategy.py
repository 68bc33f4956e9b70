"""Join-side decisions made from measured sizes.

A side is broadcast only after its bytes were added up and found small; past
the bound the plan keeps a shuffle join (AQE splits skewed partitions).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BROADCAST_MAX_BYTES

ROW_BYTES = 32          # what a row takes beside its values


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column)
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType))
        size = F.size(column) * 8 if fixed else F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = reduce(lambda a, b: a + b, [value_bytes(column[f.name], f.dataType) for f in kind.fields])
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0)).cast("long") + 8


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows, added up by Spark."""
    each = reduce(lambda a, b: a + b, [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(ROW_BYTES))
    return df.agg(F.coalesce(F.sum(each), F.lit(0)).alias("n")).first().n


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES, size_probe: DataFrame | None = None) -> DataFrame:
    """Mark ``df`` for a broadcast when ``size_probe`` (default: itself) takes at
    most ``max_bytes``. A probe lets callers measure something cheap that is no
    smaller, such as the raw query terms before a lookup."""
    return F.broadcast(df) if measured_bytes(df if size_probe is None else size_probe) <= max_bytes else df
