"""Estimated memory size of a table: type widths times rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridsmith.frame import Table

#: Bytes a row by type; others take OTHER.
WIDTHS = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.StringType: 24, T.BinaryType: 54, T.ArrayType: 100, T.StructType: 50}
OTHER = 8


def width_bytes(kind: T.DataType, n: int) -> int:
    if isinstance(kind, T.BooleanType):
        return n // 8 + 1
    return n * next((w for t, w in WIDTHS.items() if isinstance(kind, t)), OTHER)


def human(size: float, bits: bool = False) -> str:
    """1024-based units with two decimals."""
    if bits:
        return f"{int(size * 8)} bits"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            return f"{int(size)} B" if unit == "B" else f"{size:.2f} {unit}"
        size /= 1024


def size(table: Table, per_column: bool = False, per_row: bool = False, bits: bool = False, file_size: int | None = None) -> DataFrame:
    """(metric, value) rows: rows, columns, memory, and by column or row if asked; the row count is the only pass."""
    n = table.df.count()
    fields = table.schema.fields
    each = {f.name: width_bytes(f.dataType, n) for f in fields}
    total = sum(each.values())
    out = [("total_rows", str(n)), ("total_columns", str(len(fields)))]
    if file_size is not None:
        out.append(("file_size", human(file_size, bits)))
    out.append(("memory_size", human(total, bits)))
    if per_row:
        out.append(("average_row_size", human(total / n if n else 0, bits)))
    if per_column:
        out += [(f"column_{name}", human(b, bits)) for name, b in each.items()]
    return table.rows.sparkSession.createDataFrame(out, "metric string, value string")
