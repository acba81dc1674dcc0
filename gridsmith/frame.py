"""``Table``: a DataFrame whose rows know their place.

``df`` shows the visible columns.  The hidden RID column gives the row order; it
is dense (1..N) right after reading and sparse after rows were dropped, and
operators that need row numbers make it dense again by a two-level count.  After
a sort the order is that of the sort keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.plans import rowid
from gridsmith.plans.rowid import RID


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Table:
    def __init__(self, rows: DataFrame, dense: bool = True, renumber: Callable[[DataFrame], DataFrame] | None = None):
        """``rows`` has RID.  ``renumber`` gives it anew where the order is not RID's (after a sort)."""
        if RID not in rows.columns:
            raise ValueError(f"rows need the column {RID}")
        self.rows, self.dense, self._renumber = rows, dense, renumber

    @classmethod
    def of(cls, df: DataFrame, order_by: list[str] | None = None) -> Table:
        """A table of any DataFrame: rows in scan order, or by ``order_by`` (ties in scan order)."""
        table = cls(rowid.by_partition(df))
        if order_by:
            from gridsmith.operators.sorting import sort

            table = sort(table, order_by).settled()
        return table

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != RID]

    @property
    def schema(self):
        return self.df.schema

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*[quoted(c) for c in self.columns])

    def settled(self) -> Table:
        """The same rows with a dense RID in their order."""
        if self._renumber:
            return Table(self._renumber(self.rows))
        return self if self.dense else Table(rowid.dense(self.rows))

    def ordered(self) -> Table:
        """The same rows with an RID that follows their order, dense or not."""
        return self.settled() if self._renumber else self

    def with_rows(self, rows: DataFrame, dropped: bool = False) -> Table:
        """Row-local change: the order stays; ``dropped`` if some rows are gone."""
        return Table(rows, self.dense and not dropped, self._renumber)

    def where(self, test: Column) -> Table:
        return self.with_rows(self.rows.where(test), dropped=True)

    def select(self, *columns: Column) -> Table:
        return self.with_rows(self.rows.select(*columns, F.col(RID)))
