"""Dropping repeated rows and columns of equal content."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import resolve_list
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans.rowid import RID

EPSILON = 2.220446049250313e-16


def _keep(keep: str) -> str:
    if keep not in ("first", "last"):
        raise InvalidArgument(f"keep must be first or last, not {keep!r}")
    return keep


def dedup_rows(table: Table, columns: str | None = None, keep: str = "first") -> Table:
    """One row for each combination of ``columns`` (default all): the first or last in order.

    The row's number is found by an aggregate with partial sums, so that a key
    that holds a third of all rows is no task of its own; rows meet it by a join
    on the number, not by sorting whole groups.
    """
    _keep(keep)
    names = table.columns if columns is None else resolve_list(table.columns, columns)
    if not names:
        return table
    table = table.ordered()
    pick = (F.min if keep == "first" else F.max)(RID)
    if set(names) == set(table.columns):
        # nothing but the key is in the row: the aggregate is the result
        rows = table.rows.groupBy(*[quoted(c) for c in names]).agg(pick.alias(RID))
        return table.with_rows(rows.select(*[quoted(c) for c in table.columns], RID), dropped=True)
    if all(isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)) for f in table.schema):
        others = [c for c in table.columns if c not in names]
        best = (F.min_by if keep == "first" else F.max_by)(F.struct(*[quoted(c) for c in others]), F.col(RID)).alias("__v")
        rows = table.rows.groupBy(*[quoted(c) for c in names]).agg(best, pick.alias(RID))
        return table.with_rows(rows.select(*[quoted(c) if c in names else F.col("__v").getField(c).alias(c) for c in table.columns], RID), dropped=True)
    order = F.col(RID).asc() if keep == "first" else F.col(RID).desc()
    rows = table.rows.withColumn("__n", F.row_number().over(Window.partitionBy(*[quoted(c) for c in names]).orderBy(order)))
    return table.with_rows(rows.where("__n = 1").drop("__n"), dropped=True)


def dedup_columns(table: Table, columns: str | None = None, keep: str = "first") -> Table:
    """One column of each group with the same type and content; one pass finds equal pairs (a driver round trip).

    A first pass compares one hash sum a column, so that only columns that may be
    equal are compared value by value (floats within an epsilon).
    """
    _keep(keep)
    names = table.columns if columns is None else resolve_list(table.columns, columns)
    pairs = [(a, b) for a, b in combinations(names, 2) if table.schema[a].dataType == table.schema[b].dataType]
    if pairs:
        floats = {n for n in names if isinstance(table.schema[n].dataType, (T.FloatType, T.DoubleType))}
        some = sorted({n for p in pairs for n in p} - floats)
        sums = table.rows.agg(*[F.sum(F.xxhash64(quoted(n)).cast("decimal(38,0)")).alias(f"h{i}") for i, n in enumerate(some)], F.count(F.lit(1)).alias("n")).first()
        hashed = {n: sums[f"h{i}"] for i, n in enumerate(some)}
        pairs = [(a, b) for a, b in pairs if a in floats or hashed[a] == hashed[b]]
    if pairs:

        def same(a, b):
            x, y = quoted(a), quoted(b)
            equal = x.eqNullSafe(y)
            return equal | F.coalesce(F.abs(x - y) <= EPSILON, F.lit(False)) if a in floats else equal

        got = table.rows.agg(*[F.coalesce(F.bool_and(same(a, b)), F.lit(True)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        pairs = [p for i, p in enumerate(pairs) if got[f"p{i}"]]
    group = {n: n for n in names}
    for a, b in pairs:
        group[b] = group[a]
    members: dict[str, list[str]] = {}
    for n in names:
        members.setdefault(group[n], []).append(n)
    gone = {n for own in members.values() for n in (own[1:] if keep == "first" else own[:-1])}
    return table.select(*[quoted(c) for c in table.columns if c not in gone])
