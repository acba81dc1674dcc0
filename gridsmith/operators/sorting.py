"""Sorting by several keys, each with its own strategy, direction and null placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.columns import is_text, resolve_one
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans import rowid, store
from gridsmith.plans.rowid import RID

STRATEGIES = ("auto", "numeric", "num", "date", "hour", "time", "alphabetic", "alpha", "alphabetic-numeric", "numeric-alphabetic")


def date_format(text: str) -> str:
    """yyyy, yy, mm and dd as Spark's letters."""
    return text.replace("mm", "MM")


def time_format(text: str) -> str:
    """hh, mm and ss as Spark's letters."""
    return text.replace("hh", "HH")


def sort_key(table: Table, name: str, strategy: str, dates: str | None, hours: str | None, ignore_case: bool) -> Column:
    c, kind = quoted(name), table.schema[name].dataType
    text = is_text(kind)
    folded = F.lower(c) if text and ignore_case else c
    if strategy not in STRATEGIES:
        raise InvalidArgument(f"Unknown sort strategy {strategy!r}")
    if strategy in ("numeric", "num"):
        return c.cast("double") if text else c
    if strategy == "date":
        return (F.to_date(c, date_format(dates)) if dates else F.to_date(c)) if text else c
    if strategy in ("hour", "time"):
        if not text or hours and "xxx" in hours:
            return c
        return F.to_timestamp(c, time_format(hours)) if hours else F.to_timestamp(c)
    if strategy in ("alphabetic", "alpha", "alphabetic-numeric"):
        return folded if text else c.cast("string")
    return folded if strategy == "auto" else c


def _listed(value, n: int, what: str) -> list:
    items = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple)) else [value]
    if len(items) == 1:
        items *= n
    if len(items) != n:
        raise InvalidArgument(f"Number of {what} must be 1 or match the {n} sort columns")
    return items


def sort(table: Table, columns: str | list[str] = "all", strategy: str | list[str] = "auto", descending: bool | str | list[bool] = False, nulls: str = "last", date_fmt: str | None = None, hour_fmt: str | None = None, ignore_case: bool = False) -> Table:
    """Rows by the keys; ties keep their order.  ``nulls`` is first, last or skip, whatever the direction."""
    names = columns.split(",") if isinstance(columns, str) else list(columns)
    names = table.columns if columns == "all" else [resolve_one(table.columns, n) for n in names]
    if nulls not in ("first", "last", "skip"):
        raise InvalidArgument(f"Unknown null placement {nulls!r}")
    down = [d if isinstance(d, bool) else str(d).lower() in ("true", "t", "1", "desc") for d in _listed(descending, len(names), "directions")]
    ways = _listed(strategy, len(names), "strategies")
    table = table.ordered()
    rows = table.rows
    if nulls == "skip":
        for n in names:
            rows = rows.where(quoted(n).isNotNull())
    keys = [sort_key(table, n, w, date_fmt, hour_fmt, ignore_case) for n, w in zip(names, ways, strict=True)]

    def placed(key: Column, desc: bool) -> Column:
        if nulls == "first":
            return key.desc_nulls_first() if desc else key.asc_nulls_first()
        return key.desc_nulls_last() if desc else key.asc_nulls_last()

    order = [placed(k, d) for k, d in zip(keys, down, strict=True)] + [F.col(RID).asc()]

    def renumber(df: DataFrame) -> DataFrame:
        """Dense numbers in sort order: the rows written once in ranges of the whole key, row number and all, and numbered by file."""
        return rowid.from_parquet(store.written(df.orderBy(*order).drop(RID)))

    return Table(rows.orderBy(*order), False, renumber)
