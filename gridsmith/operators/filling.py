"""Filling missing values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import is_numeric, is_text, resolve_list
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans import quantiles
from gridsmith.plans.rowid import BLOCK, RID


def _names(table: Table, columns: str | None) -> list[str]:
    return resolve_list(table.columns, columns) if columns else table.columns


def _filled(table: Table, new: dict) -> Table:
    return table.select(*[new[c].alias(c) if c in new else quoted(c) for c in table.columns])


def fill_value(table: Table, value: str | None, columns: str | None = None) -> Table:
    """A constant, parsed for each numeric or text column; other types are left alone."""
    if value is None:
        raise InvalidArgument("A value must be specified")
    new = {}
    for name in _names(table, columns):
        kind = table.schema[name].dataType
        try:
            if isinstance(kind, T.IntegralType):
                new[name] = F.coalesce(quoted(name), F.lit(int(str(value))).cast(kind))
            elif is_numeric(kind):
                new[name] = F.coalesce(quoted(name), F.lit(float(value)).cast(kind))
            elif is_text(kind):
                new[name] = F.coalesce(quoted(name), F.lit(str(value)))
        except ValueError:
            raise InvalidArgument(f"Cannot fill column {name!r} with {value!r}") from None
    return _filled(table, new)


def fill_statistic(table: Table, method: str, columns: str | None = None, accuracy: int | None = None) -> Table:
    """Each column's mean, median or mode, all from one aggregate whose single row is broadcast.

    Without ``columns`` mean and median take the numeric ones.  ``accuracy`` asks
    for an approximate median of one pass; the exact one counts all columns'
    values.  Ties of the mode go to the least value.
    """
    kinds = {f.name: f.dataType for f in table.schema.fields}
    names = _names(table, columns)
    if method in ("mean", "median"):
        if columns is None:
            names = [n for n in names if is_numeric(kinds[n])]
        if bad := [n for n in names if not is_numeric(kinds[n])]:
            raise InvalidArgument(f"Column {bad[0]!r} is not numeric")
    if method == "mode":
        return _fill_mode(table, names)
    if method not in ("mean", "median"):
        raise InvalidArgument(f"Unknown fill method {method!r}")
    if not names:
        return table

    values = [quoted(n).cast("double") for n in names]
    if method == "mean":
        stats = table.rows.agg(*[F.avg(x).alias(f"__s{i}") for i, x in enumerate(values)])
    else:
        stats = quantiles.row_of(table.rows, values, [0.5], accuracy).select(*[F.get(f"q{i}", F.lit(0)).alias(f"__s{i}") for i in range(len(names))])
    rows = table.rows.crossJoin(F.broadcast(stats))  # one row
    new = {n: F.coalesce(quoted(n), F.col(f"__s{i}")).alias(n) for i, n in enumerate(names)}
    return table.with_rows(rows.select(*[new.get(c, quoted(c)) for c in table.columns], RID))


def _fill_mode(table: Table, names: list[str]) -> Table:
    """Modes of all columns from one count of their values (partial sums), not a buffer or a pass a column."""
    fields = {f.name: f.dataType for f in table.schema.fields}
    if not names:
        return table
    as_is = lambda j: F.struct(*[(quoted(n) if k == j else F.lit(None).cast(fields[n])).alias(f"v{k}") for k, n in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(j).alias("i"), quoted(n).isNotNull().alias("has"), as_is(j).alias("v")) for j, n in enumerate(names)])
    counts = table.rows.select(F.explode(pairs).alias("p")).where("p.has").groupBy(F.col("p.i").alias("i"), F.col("p.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    # the most frequent, and of those the least
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("c")).alias("c"), "v")).alias("m"))
    modes = best.agg(*[F.max(F.when(F.col("i") == j, F.col(f"m.v.v{j}"))).alias(f"__m{j}") for j in range(len(names))])
    rows = table.rows.crossJoin(F.broadcast(modes))  # one row
    new = {n: F.coalesce(quoted(n), F.col(f"__m{i}")).alias(n) for i, n in enumerate(names)}
    return table.with_rows(rows.select(*[new.get(c, quoted(c)) for c in table.columns], RID))


def fill_direction(table: Table, method: str, columns: str | None = None, block: int = BLOCK) -> Table:
    """The last value before (``forward``) or the next after (``backward``) in row order.

    Rows are cut into blocks by row number; each block's last value is carried over
    the (few) blocks, and a window runs only inside each block.
    """
    if method not in ("forward", "backward"):
        raise InvalidArgument(f"Unknown fill method {method!r}")
    names = _names(table, columns)
    if not names:
        return table
    table = table.ordered()
    ahead = method == "forward"
    rows = table.rows.withColumn("__b", F.floor((F.col(RID) - 1) / block))
    pick = F.max_by if ahead else F.min_by
    ends = rows.groupBy("__b").agg(*[pick(F.when(quoted(n).isNotNull(), quoted(n)), F.when(quoted(n).isNotNull(), F.col(RID))).alias(f"__e{i}") for i, n in enumerate(names)])
    over = Window.orderBy(F.col("__b").asc() if ahead else F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__b").alias("__b2"), *[F.last(f"__e{i}", ignorenulls=True).over(over).alias(f"__c{i}") for i in range(len(names))])
    within = Window.partitionBy("__b").orderBy(F.col(RID).asc() if ahead else F.col(RID).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(ends, F.col("__b") == F.col("__b2"))
    new = {n: F.coalesce(F.last(quoted(n), ignorenulls=True).over(within), F.col(f"__c{i}")).alias(n) for i, n in enumerate(names)}
    return table.with_rows(rows.select(*[new.get(c, quoted(c)) for c in table.columns], RID))


def fill(table: Table, method: str = "value", value: str | None = None, columns: str | None = None) -> Table:
    if method == "value":
        return fill_value(table, value, columns)
    if method in ("forward", "backward"):
        return fill_direction(table, method, columns)
    return fill_statistic(table, method, columns)
