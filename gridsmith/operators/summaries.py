"""Counts, frequencies, pivots and column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import is_numeric, is_text, resolve_list
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans import quantiles


def count_rows(table: Table) -> DataFrame:
    """row_count; no column is read."""
    return table.df.agg(F.count(F.lit(1)).alias("row_count"))


def frequency(table: Table, columns: str, percentage: bool = False, ordered: bool = True) -> DataFrame:
    """Rows of each combination of values, nulls too, most frequent first (ties by value)."""
    names = resolve_list(table.columns, columns)
    if not names:
        raise InvalidArgument("Columns must be specified")
    out = table.df.groupBy(*[quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("frequency"))
    if percentage:
        # the total is a second, one-row aggregate of the counts
        total = out.agg(F.sum("frequency").alias("__t"))
        out = out.crossJoin(F.broadcast(total)).select(*[quoted(n) for n in names], "frequency", F.round(100 * F.col("frequency") / F.col("__t"), 1).alias("percentage"))
    return out.orderBy(F.col("frequency").desc(), *[quoted(n) for n in names]) if ordered else out


def distinct_values(table: Table, column: str) -> DataFrame:
    (name,) = resolve_list(table.columns, column)
    return table.df.select(quoted(name)).distinct().orderBy(quoted(name))


AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def pivot(table: Table, index: str, columns: str, values: str | None = None, agg: str = "sum", fill: str | float | None = None, wide: bool = False) -> DataFrame:
    """Aggregates by index and pivot columns, one ``{value}_{agg}`` for each value column.

    ``wide`` spreads the pivot columns' values over columns instead (their list
    takes a driver round trip) and puts ``fill`` where a cell has no rows.
    """
    rows, cols = resolve_list(table.columns, index), resolve_list(table.columns, columns)
    if agg not in AGGREGATES:
        raise InvalidArgument(f"Unknown aggregate {agg!r}")
    if not rows or not cols:
        raise InvalidArgument("index and columns must be specified")
    if values:
        vals = resolve_list(table.columns, values)
        for v in vals:
            if not is_numeric(table.schema[v].dataType):
                raise InvalidArgument(f"Column {v!r} is not numeric")
    else:
        vals = [f.name for f in table.schema if is_numeric(f.dataType) and f.name not in rows + cols]
    if not vals:
        raise InvalidArgument("No numeric columns to aggregate")
    made = [AGGREGATES[agg](quoted(v)).alias(f"{v}_{agg}") for v in vals]
    if not wide:
        return table.df.groupBy(*[quoted(c) for c in dict.fromkeys(rows + cols)]).agg(*made)
    key = quoted(cols[0]).cast("string") if len(cols) == 1 else F.concat_ws("_", *[quoted(c).cast("string") for c in cols])
    out = table.df.withColumn("__key", F.coalesce(key, F.lit("null"))).groupBy(*[quoted(c) for c in rows]).pivot("__key").agg(*made)
    if fill is not None:
        cells = [c for c in out.columns if c not in rows]
        out = out.na.fill(float(fill), subset=cells)
    return out


def stats(table: Table, columns: str | None = None, kind: str = "basic", accuracy: int | None = None, approximate_distinct: bool = False) -> DataFrame:
    """A row of statistics for each numeric or text column; other types are skipped.

    basic: column_name, count, mean, q25, q50, q75, num_classes.  exhaustive:
    column_name, count, mean, std_dev, min_val, q25, median, q75, max_val,
    variance (of the population), num_classes, duplicates.  Moments take one pass;
    quantiles (interpolated) and distinct counts come from one count of all columns'
    values.  ``accuracy`` makes quantiles and ``approximate_distinct`` distinct
    counts approximate, each within the first pass, for very large inputs.
    """
    if kind == "hypothesis":
        raise NotImplementedError("Hypothesis tests are not yet implemented")
    if kind not in ("basic", "exhaustive"):
        raise InvalidArgument(f"Unknown statistics {kind!r}")
    names = resolve_list(table.columns, columns) if columns else table.columns
    fields = [table.schema[n] for n in names]
    fields = [f for f in fields if is_numeric(f.dataType) or is_text(f.dataType)]
    if not fields:
        raise InvalidArgument("No numeric or string columns found")
    df, made, rows = table.df, [], []
    for i, f in enumerate(fields):
        c, x = quoted(f.name), quoted(f.name).cast("double")
        made.append(F.count(c).alias(f"count{i}"))
        if approximate_distinct:
            made.append(F.approx_count_distinct(c).alias(f"classes{i}"))
        if is_numeric(f.dataType):
            made += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std_dev{i}"), F.min(x).alias(f"min_val{i}"), F.max(x).alias(f"max_val{i}"), F.var_pop(x).alias(f"variance{i}")]
            if accuracy:
                made.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"q{i}"))
        get = lambda what, i=i, f=f: F.col(f"{what}{i}") if is_numeric(f.dataType) else F.lit(None).cast("double")
        q = F.col(f"q{i}") if accuracy and is_numeric(f.dataType) else F.lit(None).cast("array<double>")
        classes = F.col(f"classes{i}") if approximate_distinct else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.col(f"count{i}").alias("count"), *[get(k).alias(k) for k in ("mean", "std_dev", "min_val", "max_val", "variance")], q.alias("q"), classes.alias("num_classes")))
    out = df.agg(*made).select(F.inline(F.array(*rows)))
    if not (accuracy and approximate_distinct):
        counts = quantiles.value_counts(df, [(quoted(f.name), f.dataType) for f in fields])
        if not approximate_distinct:
            classes = counts.groupBy("i").agg(F.count(F.lit(1)).alias("found"))
            out = out.join(F.broadcast(classes), "i", "left").withColumn("num_classes", F.coalesce("found", F.lit(0))).drop("found")  # one row a column
        if not accuracy:
            out = out.drop("q").join(F.broadcast(quantiles.of_counts(counts, [0.25, 0.5, 0.75])), "i", "left")  # one row a column
    q = [F.get("q", F.lit(k)) for k in range(3)]
    out = out.orderBy("i")
    if kind == "basic":
        return out.select("column_name", "count", "mean", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "num_classes")
    return out.select("column_name", "count", "mean", "std_dev", "min_val", q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), "max_val", "variance", "num_classes", (F.col("count") - F.col("num_classes")).alias("duplicates"))


def category_counts(table: Table, column: str) -> DataFrame:
    (name,) = resolve_list(table.columns, column)
    total = F.sum("count").over(Window.partitionBy())
    out = table.df.where(quoted(name).isNotNull()).groupBy(quoted(name)).agg(F.count(F.lit(1)).alias("count"))
    return out.withColumn("share", F.col("count") / total)


def kind_of(dtype: T.DataType) -> str:
    return "numeric" if is_numeric(dtype) else "text" if is_text(dtype) else "other"
