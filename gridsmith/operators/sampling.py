"""Sampling, shuffling and splitting by a seeded hash of the row number.

The order of md5(row number, seed) is the same on any number of partitions, so a
seed fixes the result.  Ranks in that order come from two-level counts.
"""

from __future__ import annotations

import random as _random

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from gridsmith.columns import resolve_one
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.operators import filtering
from gridsmith.plans import rowid
from gridsmith.plans.rowid import RID


def _seed(seed: int | None) -> int:
    """One seed for all parts of a result, also where the user gave none."""
    return _random.SystemRandom().randrange(1 << 31) if seed is None else seed


def shuffle(table: Table, seed: int | None = None) -> Table:
    """A permutation of the rows (a range-partitioned sort that spills)."""
    table, seed = table.settled(), _seed(seed)
    return Table(table.rows.orderBy(rowid.shuffled_key(seed), RID), False, lambda df: rowid.by_hash(df, seed))


def sample(table: Table, n: int = 10, method: str = "random", stratify_by: str | None = None, seed: int | None = None) -> Table:
    """``random`` (exactly n rows, in file order), ``first``, ``last`` or ``stratified``."""
    if method == "first":
        return filtering.head(table, n)
    if method == "last":
        return filtering.tail(table, n)
    if method == "stratified":
        if not stratify_by:
            raise InvalidArgument("stratify_by must be specified for stratified sampling")
        return stratified_sample(table, n, stratify_by, seed)
    if method != "random":
        raise InvalidArgument(f"Unknown sampling method {method!r}")
    table = table.settled()
    # the limit takes the n least of each partition first, so only n rows a task travel
    return table.with_rows(table.rows.orderBy(rowid.shuffled_key(_seed(seed)), RID).limit(n), dropped=True)


def preview(table: Table, n: int = 5, seed: int | None = None) -> Table:
    """n random rows, shown in file order."""
    picked = sample(table, n, seed=seed)
    return picked.with_rows(picked.rows.orderBy(RID))


def _ranked(table: Table, stratum: str, seed: int | None) -> Table:
    """``__rank`` (1-based, in hash order, or file order without a seed) within each stratum.

    Strata may be hot, so ranks come from counts by (stratum, key prefix) and a
    numbering inside each of these.
    """
    table = table.settled()
    key = rowid.shuffled_key(seed) if seed is not None else F.lpad(F.col(RID).cast("string"), 19, "0")
    prefix = F.substring("__key", 1, 3) if seed is not None else F.substring("__key", 1, 14)
    rows = table.rows.where(quoted(stratum).isNotNull()).withColumn("__key", key)
    rows = rowid.numbered(rows, F.struct(quoted(stratum).alias("s"), prefix.alias("p")), F.col("__b"), [F.col("__key"), F.col(RID)], "__place")
    sizes = rows.groupBy(quoted(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__s", "__size", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__total"))
    rows = rows.join(sizes, quoted(stratum) == F.col("__s")).withColumn("__rank", F.col("__place") - F.col("__start"))
    return table.with_rows(rows, dropped=True)


def stratified_sample(table: Table, n: int, stratify_by: str, seed: int | None = None) -> Table:
    """min(n, rows) rows with each stratum's share of them; null strata are left out.

    Quotas are the shares rounded down; what is missing goes to the largest
    remainders, then by stratum.  Strata are a small table (one row each).
    """
    stratum = resolve_one(table.columns, stratify_by)
    names, ranked = table.columns, _ranked(table, stratum, _seed(seed))
    sizes = ranked.rows.groupBy(F.col("__s").alias("__t")).agg(F.first("__size").alias("z"), F.first("__total").alias("total"))
    want = F.least(F.lit(n), F.col("total"))
    sizes = sizes.withColumn("exact", want * F.col("z") / F.col("total")).withColumn("base", F.floor("exact"))
    short = want - F.sum("base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy((F.col("exact") - F.col("base")).desc(), "__t"))
    quotas = sizes.select("__t", (F.col("base") + (place <= short).cast("long")).alias("__quota"))
    rows = ranked.rows.join(quotas, F.col("__s") == F.col("__t")).where("__rank <= __quota")
    return table.with_rows(rows.select(*[quoted(c) for c in names], RID), dropped=True)


def ratios(spec: str | list[float]) -> list[float]:
    """Shares that add up to 1 (or 100), each above 0."""
    try:
        parts = [float(p) for p in spec.split(",")] if isinstance(spec, str) else [float(p) for p in spec]
    except ValueError:
        raise InvalidArgument(f"Invalid ratio {spec!r}") from None
    total = sum(parts)
    if any(p <= 0 for p in parts) or not (abs(total - 1) <= 0.001 or abs(total - 100) <= 0.001):
        raise InvalidArgument("Ratios must be positive and must sum to 1.0 or 100.0")
    return [p / 100 for p in parts] if abs(total - 100) <= 0.001 else parts


def _part(rank: Column, total: Column, shares: list[float]) -> Column:
    """The 0-based part of a 1-based rank: sizes round(total * share), the last takes the rest."""
    out, end = F.lit(len(shares) - 1), F.lit(0)
    tests = []
    for i, s in enumerate(shares[:-1]):
        end = end + F.round(total * s).cast("long")
        tests.append((rank <= end, i))
    for test, i in reversed(tests):
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def split(table: Table, ratio: str | list[float], stratified_by: str | None = None, seed: int | None = None) -> list[Table]:
    """Disjoint parts of the rows, in hash order; of each stratum if given (unseeded strata stay in file order)."""
    shares, names = ratios(ratio), table.columns
    if stratified_by:
        ranked = _ranked(table, resolve_one(names, stratified_by), seed)
        rows = ranked.rows.withColumn("__part", _part(F.col("__rank"), F.col("__size"), shares))
    else:
        table = table.settled()
        rows = rowid.by_hash(table.rows.withColumn("__file", F.col(RID)), _seed(seed), "__rank")
        total = rows.agg(F.count(F.lit(1)).alias("__total"))
        rows = rows.crossJoin(F.broadcast(total)).withColumn("__part", _part(F.col("__rank"), F.col("__total"), shares))
    return [table.with_rows(rows.where(F.col("__part") == i).select(*[quoted(c) for c in names], RID), dropped=True) for i in range(len(shares))]


def split_names(n: int, names: str | None = None, prefix: str = "split", extension: str = "parquet") -> list[str]:
    """File names of the parts: given ones (with an extension added where there is none), or prefix_1, prefix_2, ..."""
    if names:
        given = [x.strip() for x in names.split(",")]
        if len(given) != n:
            raise InvalidArgument(f"Number of names ({len(given)}) must match number of splits ({n})")
        return [x if "." in x else f"{x}.{extension}" for x in given]
    return [f"{prefix}_{i + 1}.{extension}" for i in range(n)]
