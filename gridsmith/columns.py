"""Column names and types: the two lookup rules and what counts as numeric."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from gridsmith.errors import ColumnNotFound, InvalidArgument

#: Marks of a pattern; any other token is a plain name.
PATTERN_MARKS = frozenset("*^$")


def unquoted(token: str) -> str:
    token = token.strip()
    return token[1:-1] if len(token) >= 2 and token[0] == token[-1] == '"' else token


def resolve_one(columns: list[str], name: str) -> str:
    """The column called ``name``: exactly, else in any case; quotes around it are dropped."""
    name = unquoted(name)
    if name in columns:
        return name
    for c in columns:
        if c.lower() == name.lower():
            return c
    raise ColumnNotFound([name], list(columns))


def resolve_list(columns: list[str], spec: str | list[str] | None) -> list[str]:
    """Columns of a comma-separated list of names and patterns, in its order, without repeats.

    A token with ``*``, ``^`` or ``$`` that is no column is a regular expression,
    searched for anywhere in the names; its columns come in schema order.
    """
    tokens = spec.split(",") if isinstance(spec, str) else list(spec or [])
    out: dict[str, None] = {}
    missing = []
    for token in filter(None, map(unquoted, tokens)):
        try:
            found = [resolve_one(columns, token)]
        except ColumnNotFound:
            found = []
            if PATTERN_MARKS & set(token):
                try:
                    found = list(columns) if token == "*" else [c for c in columns if re.search(token, c)]
                except re.error as e:
                    raise InvalidArgument(f"Invalid pattern {token!r}: {e}") from e
        if not found:
            missing.append(token)
        out.update(dict.fromkeys(found))
    if missing:
        raise ColumnNotFound(missing, list(columns))
    return list(out)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


#: Arrow-style names of types, for schema reports.
ARROW_NAMES = {T.ByteType: "Int8", T.ShortType: "Int16", T.IntegerType: "Int32", T.LongType: "Int64", T.FloatType: "Float32", T.DoubleType: "Float64", T.StringType: "Utf8", T.BooleanType: "Boolean", T.DateType: "Date32", T.BinaryType: "Binary", T.TimestampType: "Timestamp(Microsecond, UTC)", T.TimestampNTZType: "Timestamp(Microsecond, None)"}


def arrow_name(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"Decimal128({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"List({arrow_name(kind.elementType)})"
    if isinstance(kind, T.StructType):
        return "Struct(" + ", ".join(f"{f.name}: {arrow_name(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"Map({arrow_name(kind.keyType)}, {arrow_name(kind.valueType)})"
    return ARROW_NAMES.get(type(kind), kind.simpleString())
