"""Choosing rows: conditions, row numbers, value search, head and tail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import is_numeric, is_text, resolve_list
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans.rowid import RID
from gridsmith.predicates import conditions, in_ranges, row_ranges


def _every(tests):
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_where(table: Table, spec: str) -> Table:
    return table.where(conditions(table.schema, spec))


def filter_rows(table: Table, kind: str) -> Table:
    """``no-nan`` (no null), ``numeric-only``, ``char-only`` or ``no-zeros``; null comparisons drop the row."""
    fields = table.schema.fields
    numeric = [quoted(f.name) for f in fields if is_numeric(f.dataType)]
    text = [quoted(f.name) for f in fields if is_text(f.dataType)]
    if kind == "no-nan":
        return table.where(_every([quoted(f.name).isNotNull() for f in fields]))
    if kind == "numeric-only":
        if not numeric:
            raise InvalidArgument("No numeric columns found")
        return table.where(_every([c.isNotNull() for c in numeric]))
    if kind == "char-only":
        if not text:
            raise InvalidArgument("No string columns found")
        return table.where(_every([c.isNotNull() & (c != "") for c in text]))
    if kind == "no-zeros":
        return table.where(_every([c != 0 for c in numeric])) if numeric else table
    raise InvalidArgument(f"Unknown row filter {kind!r}")


def drop_where(table: Table, spec: str) -> Table:
    """Rows for which the conditions are false; those for which they are unknown go too."""
    return table.where(~conditions(table.schema, spec))


def select_rows(table: Table, spec: str) -> Table:
    return table.settled().where(in_ranges(F.col(RID), row_ranges(spec)))


def drop_rows(table: Table, spec: str) -> Table:
    """Row numbers, or conditions if the text has a comparison in it."""
    if any(ch in spec for ch in "=<>"):
        return drop_where(table, spec)
    return table.settled().where(~in_ranges(F.col(RID), row_ranges(spec)))


def _searchable(table: Table, columns: str | None) -> list[str]:
    names = resolve_list(table.columns, columns) if columns else table.columns
    kinds = (T.StringType, T.LongType, T.DoubleType, T.IntegerType, T.FloatType, T.ShortType, T.ByteType)
    return [n for n in names if isinstance(table.schema[n].dataType, kinds)]


def search_test(table: Table, value: str, columns: str | None = None, ignore_case: bool = False, exact: bool = False):
    """(any column matches, the columns searched).  Numbers are searched only for numbers: equal, or as part of their text."""
    tests, used = [], []
    try:
        number = float(value)
    except ValueError:
        number = None
    for name in _searchable(table, columns):
        c = quoted(name)
        if is_text(table.schema[name].dataType):
            left, right = (F.lower(c), value.lower()) if ignore_case else (c, value)
            tests.append(left == right if exact else F.contains(left, F.lit(right)))
        elif number is not None:
            tests.append(c == F.lit(number) if exact else F.contains(c.cast("string"), F.lit(value)))
        else:
            continue
        used.append(name)
    if not tests:
        raise InvalidArgument("No searchable columns")
    return reduce(lambda a, b: a | b, tests), used


def search(table: Table, value: str, columns: str | None = None, ignore_case: bool = False, exact: bool = False) -> Table:
    return table.where(search_test(table, value, columns, ignore_case, exact)[0])


def search_positions(table: Table, value: str, columns: str | None = None, ignore_case: bool = False, exact: bool = False) -> Table:
    """row_number, search_value and matched_columns (the columns searched) of matching rows."""
    table = table.settled()
    test, used = search_test(table, value, columns, ignore_case, exact)
    return table.where(test).select(F.col(RID).alias("row_number"), F.lit(value).alias("search_value"), F.lit(", ".join(used)).alias("matched_columns"))


def head(table: Table, n: int = 5) -> Table:
    """The first rows: a filter on the row number with a limit, so that a fresh scan stops early."""
    table = table.settled()
    return table.with_rows(table.rows.where(F.col(RID) <= n).limit(n), dropped=False)


def tail(table: Table, n: int = 5) -> Table:
    """The last rows; one count (footers only, for a fresh Parquet scan) gives where they begin."""
    table = table.settled()
    total = table.rows.count()
    return table.where(F.col(RID) > total - n)


def page(table: Table, number: int, size: int = 1000) -> Table:
    """The rows of a 0-based page."""
    table = table.settled()
    return table.where(F.col(RID).between(number * size + 1, (number + 1) * size))
