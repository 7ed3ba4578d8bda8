"""What the training-data operators share: Arrow access to text bytes, checked broadcasts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import drop_table, stage_table  # noqa: F401  (for the operators)

#: Rows and bytes up to which the small side of a join is broadcast; beyond, the join shuffles (AQE splits skewed keys).
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inside = F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + _width(x, kind.elementType)) if not isinstance(kind.elementType, T.NumericType) else 8 * F.size(column)
        return F.coalesce(inside, F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else as it is.  Reads a staged table."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    found = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= max_rows and (found["bytes"] or 0) <= max_bytes else df


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


def remainder(id_column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string")) % F.lit(modulus)


def own_columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns that an operator reads, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{source}`").alias(own) for own, source in named.items()))
