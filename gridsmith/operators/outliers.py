"""Outliers by four methods: all columns at once, bounds from one or two aggregates
whose single row is broadcast, flags in one pass over the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.columns import is_numeric, resolve_list
from gridsmith.errors import StatisticsError
from gridsmith.frame import Table, quoted
from gridsmith.plans import quantiles
from gridsmith.plans.rowid import RID

METHODS = ("iqr", "z-score", "modified-z-score", "isolation-forest")
#: Fixed constants of the methods.
MAD_SCALE, ISOLATION_SCORE, ISOLATION_MARGIN = 0.6745, 2.5, 0.1


def _names(table: Table, columns: str | None) -> list[str]:
    names = resolve_list(table.columns, columns) if columns else [f.name for f in table.schema if is_numeric(f.dataType)]
    if bad := [n for n in names if not is_numeric(table.schema[n].dataType)]:
        raise StatisticsError(f"Column {bad[0]!r} is not numeric")
    if not names:
        raise StatisticsError("No numeric columns found")
    return names


def _with_stats(rows: DataFrame, names: list[str], method: str, accuracy: int | None) -> DataFrame:
    """``rows`` with the statistics of each column, from one-row tables."""
    values = [quoted(n).cast("double") for n in names]
    if method == "iqr":
        found = quantiles.row_of(rows, values, [0.25, 0.75], accuracy)
        return rows.crossJoin(F.broadcast(found.select(*[F.col(f"q{i}").alias(f"__q{i}") for i in range(len(names))])))
    if method == "modified-z-score":
        # the medians, one value a column, take a driver round trip: else each use of them would be planned anew
        got = quantiles.row_of(rows, values, [0.5], accuracy).first()
        medians = [F.lit(got[f"q{i}"][0] if got[f"q{i}"] else None).cast("double") for i in range(len(names))]
        mads = quantiles.row_of(rows, [F.abs(x - m) for x, m in zip(values, medians, strict=True)], [0.5], accuracy)
        out = rows.select("*", *[m.alias(f"__med{i}") for i, m in enumerate(medians)])
        return out.crossJoin(F.broadcast(mads.select(*[F.get(f"q{i}", F.lit(0)).alias(f"__mad{i}") for i in range(len(names))])))
    made = []
    for i, n in enumerate(names):
        x = quoted(n).cast("double")
        made += [F.avg(x).alias(f"__mean{i}"), F.stddev_samp(x).alias(f"__sd{i}")]
        if method == "isolation-forest":
            made += [F.min(x).alias(f"__min{i}"), F.max(x).alias(f"__max{i}")]
    return rows.crossJoin(F.broadcast(rows.agg(*made)))  # one row


def _score(i: int, n: str, method: str, iqr_multiplier: float) -> tuple[Column, Column]:
    """(the value's score, whether the column can be judged); for iqr the score is null."""
    x = quoted(n).cast("double")
    if method == "iqr":
        return F.lit(None).cast("double"), F.lit(True)
    if method == "modified-z-score":
        mad = F.col(f"__mad{i}")
        return MAD_SCALE * (x - F.col(f"__med{i}")) / F.when(mad > 0, mad), mad > 0
    sd = F.col(f"__sd{i}")
    return F.abs(x - F.col(f"__mean{i}")) / F.when(sd > 0, sd), sd > 0


def _bounds(i: int, k: float) -> tuple[Column, Column]:
    q = F.col(f"__q{i}")
    return q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])


def _flag(i: int, n: str, method: str, k: float, threshold: float) -> Column:
    """Whether the value is an outlier; null for null values, false for columns without spread."""
    x = quoted(n).cast("double")
    if method == "iqr":
        lo, hi = _bounds(i, k)
        return (x < lo) | (x > hi)
    score, judged = _score(i, n, method, k)
    if method == "isolation-forest":
        lo, hi = F.col(f"__min{i}"), F.col(f"__max{i}")
        test = (score > ISOLATION_SCORE) & ((x < lo + ISOLATION_MARGIN * (hi - lo)) | (x > hi - ISOLATION_MARGIN * (hi - lo)))
    else:
        test = F.abs(score) > threshold
    return F.when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(judged, F.lit(False)) & F.coalesce(test, F.lit(False)))


def _checked(method: str) -> str:
    if method not in METHODS:
        raise StatisticsError(f"Unknown outlier method {method!r}")
    return method


def detect(table: Table, columns: str | None = None, method: str = "iqr", iqr_multiplier: float = 1.5, threshold: float = 3.0, show_values: bool = False, row_numbers: bool = False, accuracy: int | None = None) -> DataFrame:
    """A row for each outlying value of each column.

    column_name, is_outlier, method; or with ``show_values`` column_name, value,
    a score (z_score, modified_z_score, isolation_score; for iqr the bounds) and
    method.  ``row_numbers`` adds row_number.
    """
    names = _names(table, columns)
    _checked(method)
    rows = _with_stats((table.settled() if row_numbers else table).rows, names, method, accuracy)
    extra = [F.col(RID).alias("row_number")] if row_numbers else []
    cells = []
    for i, n in enumerate(names):
        x = quoted(n).cast("double")
        flag = _flag(i, n, method, iqr_multiplier, threshold).alias("is_outlier")
        parts = [F.lit(n).alias("column_name")]
        if not show_values:
            parts += [flag, F.lit(method).alias("method")]
        else:
            parts += [flag, x.alias("value")]
            if method == "iqr":
                lo, hi = _bounds(i, iqr_multiplier)
                parts += [F.lit(method).alias("method"), F.format_string("bounds: %.3f to %.3f", lo, hi).alias("bounds")]
            else:
                score = {"z-score": "z_score", "modified-z-score": "modified_z_score"}.get(method, "isolation_score")
                parts += [_score(i, n, method, iqr_multiplier)[0].alias(score), F.lit(method).alias("method")]
        cells.append(F.struct(*parts))
    out = rows.select(*extra, F.inline(F.array(*cells))).where("is_outlier")
    return out.drop("is_outlier") if show_values else out


def remove(table: Table, columns: str | None = None, method: str = "iqr", iqr_multiplier: float = 1.5, threshold: float = 3.0, accuracy: int | None = None) -> Table:
    """The rows that are inside the bounds in every column; rows with a null there go as well."""
    names = _names(table, columns)
    rows = _with_stats(table.rows, names, _checked(method), accuracy)
    keep = reduce(lambda a, b: a & b, [~_flag(i, n, method, iqr_multiplier, threshold) for i, n in enumerate(names)])
    return table.with_rows(rows.where(keep).select(*[quoted(c) for c in table.columns], RID), dropped=True)
