"""Conditions (``a>=3,b=x``) and row lists (``1,3,5-10``)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import is_numeric, resolve_one
from gridsmith.errors import InvalidArgument
from gridsmith.functions.expressions import split_top

#: Longer operators first, so that the leftmost match is the whole one.
_OPERATOR = re.compile(r">=|<=|!=|==|=|>|<")


def typed(text: str, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that no comparison is coerced."""
    text = text.strip()
    quoted = len(text) >= 2 and text[0] == text[-1] and text[0] in "'\""
    bare = text[1:-1] if quoted else text
    if is_numeric(kind):
        try:
            return F.lit(int(bare)) if re.fullmatch(r"[+-]?\d+", bare) else F.lit(float(bare))
        except ValueError:
            raise InvalidArgument(f"{bare!r} is not a number") from None
    if isinstance(kind, T.BooleanType):
        if bare.lower() not in ("true", "false"):
            raise InvalidArgument(f"{bare!r} is not true or false")
        return F.lit(bare.lower() == "true")
    if isinstance(kind, T.StringType):
        return F.lit(bare)
    return F.lit(bare).cast(kind)


def conditions(schema: T.StructType, spec: str) -> Column:
    """All conditions of a comma-separated list, joined by AND."""
    tests = []
    for part in filter(None, split_top(spec)):
        found = _OPERATOR.search(part)
        if not found:
            raise InvalidArgument(f"Invalid condition {part!r}")
        name = resolve_one(schema.names, part[: found.start()])
        column, value = F.col(f"`{name}`"), typed(part[found.end() :], schema[name].dataType)
        op = found[0]
        tests.append({">=": column >= value, "<=": column <= value, "!=": column != value, ">": column > value, "<": column < value}.get(op, column == value))
    if not tests:
        raise InvalidArgument("No conditions given")
    return reduce(lambda a, b: a & b, tests)


def row_ranges(spec: str) -> list[tuple[int, int]]:
    """Inclusive, merged ranges of a list of 1-based rows; 0 means row 1."""
    ranges = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not found:
            raise InvalidArgument(f"Invalid row specification {part!r}")
        a, b = int(found[1]), int(found[2] or found[1])
        if a > b:
            raise InvalidArgument(f"Invalid range {part!r}: start is greater than end")
        ranges.append((max(1, a), max(1, b)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def in_ranges(row: Column, ranges: list[tuple[int, int]]) -> Column:
    """Ranges stay ranges; they are never expanded to lists."""
    return reduce(lambda a, b: a | b, [(row == a) if a == b else row.between(a, b) for a, b in ranges], F.lit(False))
