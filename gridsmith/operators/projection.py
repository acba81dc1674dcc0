"""Choosing, dropping, renaming and making columns."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import arrow_name, resolve_list
from gridsmith.errors import ColumnNotFound, InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.functions.expressions import assignments, spark_sql, with_divisions
from gridsmith.plans.rowid import RID


def select_columns(table: Table, columns: str) -> Table:
    return table.select(*[quoted(c) for c in resolve_list(table.columns, columns)])


def drop_columns(table: Table, columns: str) -> Table:
    gone = set(resolve_list(table.columns, columns))
    return table.select(*[quoted(c) for c in table.columns if c not in gone])


def rename(table: Table, spec: str) -> Table:
    """``a=b,c=d``: sources must exist; final names must differ, so that swaps are fine."""
    new = {}
    for old, name in assignments(spec):
        if old not in table.columns:
            raise ColumnNotFound([old], table.columns)
        new[old] = name.strip('"')
    final = [new.get(c, c) for c in table.columns]
    if len(set(final)) < len(final):
        raise InvalidArgument(f"Column {next(c for c in final if final.count(c) > 1)!r} already exists")
    return table.select(*[quoted(c).alias(n) for c, n in zip(table.columns, final, strict=True)])


def create(table: Table, spec: str | None = None, row_filter: str | None = None, int_division: str = "double", zero_division: str = "error") -> Table:
    """New columns ``n=expr,...`` after the others, all from the input's columns; ``row_filter`` goes first.

    ``int_division="truncate"`` makes ``/`` of two integers an integer without its
    fraction, and ``zero_division="null"`` makes ``x / 0`` null.
    """
    if int_division not in ("double", "truncate") or zero_division not in ("error", "null"):
        raise InvalidArgument("int_division is double or truncate, zero_division error or null")
    plain = int_division == "double" and zero_division == "error"

    def divide(a: str, b: str) -> str:
        kinds = table.df.select(F.expr(a).alias("a"), F.expr(b).alias("b")).schema
        if int_division == "truncate" and all(isinstance(f.dataType, T.IntegralType) for f in kinds):
            return f"({a} div {f'nullif({b}, 0)' if zero_division == 'null' else b})"
        return f"try_divide({a}, {b})" if zero_division == "null" else f"({a} / {b})"

    try:
        if row_filter:
            table = table.where(F.expr(spark_sql(row_filter)))
        made = []
        for name, expr in assignments(spec) if spec else []:
            if name in table.columns or name in [n for n, _ in made]:
                raise InvalidArgument(f"Column {name!r} already exists")
            text = spark_sql(expr)
            made.append((name, F.expr(text if plain else with_divisions(text, divide)).alias(name)))
        return table.select(*[quoted(c) for c in table.columns], *[c for _, c in made])
    except (AnalysisException, ParseException) as e:
        raise InvalidArgument(f"Invalid expression: {e}") from e


def add_id(table: Table, create: bool = True, prefix: str = "id", name: str = "id") -> Table:
    """A first column of prefix and row number, or the number alone if the prefix is empty."""
    if not create:
        return table
    if name in table.columns:
        raise InvalidArgument(f"Column {name!r} already exists")
    table = table.settled()
    value = F.concat(F.lit(prefix), F.col(RID).cast("string")) if prefix else F.col(RID)
    return table.select(value.alias(name), *[quoted(c) for c in table.columns])


def headers(table: Table, pattern: str | None = None) -> DataFrame:
    """One row per column name, those found by ``pattern``; metadata only."""
    try:
        names = [c for c in table.columns if not pattern or re.search(pattern, c)]
    except re.error as e:
        raise InvalidArgument(f"Invalid pattern {pattern!r}: {e}") from e
    return table.rows.sparkSession.createDataFrame([(c,) for c in names], "header string")


def schema(table: Table) -> DataFrame:
    """column_name, data_type and nullable of each column; metadata only."""
    rows = [(f.name, arrow_name(f.dataType), f.nullable) for f in table.schema.fields]
    return table.rows.sparkSession.createDataFrame(rows, "column_name string, data_type string, nullable boolean")
