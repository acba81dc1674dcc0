"""Joins of two tables and unions of several."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridsmith.columns import resolve_one
from gridsmith.errors import InvalidArgument, SchemaMismatch
from gridsmith.frame import Table, quoted
from gridsmith.functions.expressions import assignments
from gridsmith.plans.rowid import RID


def merge(left: Table, right: Table, key: str | None = None, key_mapping: str | None = None, how: str = "inner", coalesce_key: bool = False) -> Table:
    """Inner, left or right equi-join on one column.

    Left columns keep their names; right columns but the key get the prefix
    ``r_``.  In a right join the key is null where no left row fits, unless
    ``coalesce_key``.  Join strategy is left to the optimiser (size-based
    broadcast, skew splitting).  Rows come in left order, then right.
    """
    if how not in ("inner", "left", "right"):
        raise InvalidArgument(f"Unknown join {how!r}")
    if key_mapping:
        (lk, rk), *more = assignments(key_mapping)
        if more:
            raise InvalidArgument("One key pair is expected")
        for name, side in ((lk, left), (rk, right)):
            if name not in side.columns:
                resolve_one(side.columns, name)
        lk, rk = resolve_one(left.columns, lk), resolve_one(right.columns, rk)
    elif key:
        lk, rk = resolve_one(left.columns, key), resolve_one(right.columns, key)
    else:
        raise InvalidArgument("Either key or key_mapping must be specified")
    left, right = left.ordered(), right.ordered()
    b = right.rows.select(quoted(rk).alias("__rk"), F.col(RID).alias("__rrid"), *[quoted(c).alias(f"r_{c}") for c in right.columns if c != rk])
    a = left.rows.withColumnRenamed(RID, "__lrid")
    rows = a.join(b, quoted(lk) == F.col("__rk"), how)
    kept = [F.coalesce(quoted(c), F.col("__rk")).alias(c) if coalesce_key and c == lk else quoted(c) for c in left.columns]
    # the order of the result: left row, then right row; numbered only if somebody asks
    order = F.struct(F.col("__lrid").isNull().alias("n"), F.col("__lrid").alias("l"), F.col("__rrid").alias("r")).alias("__order")
    rows = rows.select(*kept, *[F.col(f"`r_{c}`") for c in right.columns if c != rk], order, F.lit(0).cast("long").alias(RID))
    from gridsmith.plans import rowid

    def renumber(df):
        block = F.struct("__order.n", F.floor(F.coalesce("__order.l", "__order.r") / rowid.BLOCK).alias("b"))
        return rowid.numbered(df, block, F.col("__b"), [F.col("__order")])

    return _Hidden(rows, {"__order"}, renumber)


class _Hidden(Table):
    """A table with further hidden columns until it is settled."""

    def __init__(self, rows, hidden, renumber):
        super().__init__(rows, False, renumber)
        self._hidden = hidden

    @property
    def columns(self):
        return [c for c in self.rows.columns if c != RID and c not in self._hidden]

    def settled(self):
        return Table(self._renumber(self.rows).drop(*self._hidden))

    def with_rows(self, rows, dropped=False):
        return _Hidden(rows, self._hidden & set(rows.columns), self._renumber)

    def select(self, *columns):
        return self.with_rows(self.rows.select(*columns, *[F.col(c) for c in self._hidden], F.col(RID)))


def append(tables: list[Table], ignore_schema: bool = False) -> Table:
    """All rows of the first table, then the next.

    Strict: same names, types and order.  ``ignore_schema`` takes the first
    table's columns (in any case) from each; what is missing is a typed null,
    what is new is dropped.
    """
    base = tables[0]
    parts = []
    for i, t in enumerate(tables):
        if not ignore_schema:
            want, have = [(f.name, f.dataType) for f in base.schema], [(f.name, f.dataType) for f in t.schema]
            if want != have:
                raise SchemaMismatch(f"expected {want}, got {have}")
        t = t.ordered()
        by_lower = {c.lower(): c for c in t.columns}
        picked = []
        for f in base.schema.fields:
            own = f.name if f.name in t.columns else by_lower.get(f.name.lower())
            picked.append((quoted(own).cast(f.dataType) if own else F.lit(None).cast(f.dataType)).alias(f.name))
        parts.append(t.rows.select(*picked, F.lit(i).alias("__part"), F.col(RID)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    from gridsmith.plans import rowid

    def renumber(df):
        return rowid.numbered(df, F.struct("__part", F.floor(F.col(RID) / rowid.BLOCK).alias("b")), F.col("__b"), [F.col(RID)])

    return _Hidden(rows, {"__part"}, renumber)
