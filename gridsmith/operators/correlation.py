"""Correlations between numeric columns, their matrix, and tests of significance."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.columns import is_numeric, resolve_list
from gridsmith.errors import StatisticsError
from gridsmith.frame import Table, quoted
from gridsmith.functions.special import chi2_one, normal_two_sided, student_two_sided
from gridsmith.plans import store

#: Rows up to which Kendall's pairs are compared by one broadcast of both columns' values.
KENDALL_ROWS = 20_000
#: Blocks of one column that the running counts of larger tables are cut into.
KENDALL_BLOCKS = 512


def _names(table: Table, columns: str | None) -> list[str]:
    if columns:
        names = resolve_list(table.columns, columns)
        if bad := [n for n in names if not is_numeric(table.schema[n].dataType)]:
            raise StatisticsError(f"Correlation requires numeric columns only: {bad}")
    else:
        names = [f.name for f in table.schema if is_numeric(f.dataType)]
    if len(names) < 2:
        raise StatisticsError("At least two numeric columns are needed for correlation")
    return names


def _rank(df: DataFrame, key: str) -> DataFrame:
    """value, rank of the distinct non-null values of a column: average ranks, from counts of each value.

    Running counts go over blocks of values (cut at approximate quantiles), not
    over all values in one task.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    cuts = counts.agg(F.percentile_approx("__v", [i / 64 for i in range(1, 64)], 1000)).first()[0]
    block = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>"), lambda x: x < F.col("__v")))
    counts = counts.withColumn("__b", block)
    before = Window.orderBy("__b2").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(F.col("__b").alias("__b2")).agg(F.sum("__c").alias("__s"))
    sums = sums.select("__b2", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.join(F.broadcast(sums), F.col("__b") == F.col("__b2"))  # at most 64 rows
    at = F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0))
    return counts.select("__v", (at + (F.col("__c") + 1) / 2).alias("__r"))


def _numeric(table: Table, names: list[str]) -> DataFrame:
    return table.df.select(*[quoted(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)])


def _ranked(table: Table, names: list[str]) -> DataFrame:
    df = _numeric(table, names)
    rows = df
    for i in range(len(names)):
        ranks = _rank(df, f"x{i}").withColumnRenamed("__v", f"v{i}").withColumnRenamed("__r", f"r{i}")
        rows = rows.join(ranks, F.col(f"x{i}") == F.col(f"v{i}"), "left")
    return rows.select(*[F.col(f"r{i}").alias(f"x{i}") for i in range(len(names))])


def _pairwise_ranked(table: Table, a: str, b: str) -> DataFrame:
    both = table.df.where(quoted(a).isNotNull() & quoted(b).isNotNull())
    return _ranked(_Plain(both), [a, b])


class _Plain:
    """Just enough of a table for the functions above."""

    def __init__(self, df: DataFrame):
        self.df = df


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-a of two columns as one row ``tau``: exact, in rounds of merging counts.

    Concordance is counted from distinct (x, y) pairs with their multiplicities,
    so ties cost nothing; small tables are compared pairwise by a broadcast, and
    larger ones by bits of y's dense rank: at each bit, pairs that first differ
    there are counted with windows over blocks of x inside their common prefix.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    total = pairs.agg(F.sum("c").alias("n"))
    if pairs.count() <= KENDALL_ROWS:
        left, right = pairs.select("x", "y", "c"), pairs.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("c").alias("c2"))
        score = left.join(F.broadcast(right), F.col("x") < F.col("x2")).agg(F.sum(F.col("c") * F.col("c2") * F.signum(F.col("y2") - F.col("y"))).alias("s"))
    else:
        pairs = store.written(pairs)
        y, x = _rank(pairs, "y").select(F.col("__v").alias("__y"), F.col("__r").alias("__r")), _rank(pairs, "x").select(F.col("__v").alias("__x"), F.col("__r").alias("__rx"))
        ranked = pairs.join(y, F.col("y") == F.col("__y")).join(x, F.col("x") == F.col("__x")).withColumn("k", F.round(F.col("__r") * 2).cast("long"))
        top, most = ranked.agg(F.max("k"), F.max("__rx")).first()
        # blocks of x, which part the running counts of the upper bits, where all rows have one prefix
        ranked = store.written(ranked.select("x", "k", "c", F.floor(F.col("__rx") / (most + 1) * KENDALL_BLOCKS).alias("b")))
        parts = None
        for bit in range(int(top).bit_length()):
            high = F.shiftright("k", bit).bitwiseAND(1)
            by_x = ranked.groupBy(F.shiftright("k", bit + 1).alias("p"), "b", "x").agg(F.sum(F.when(high == 1, F.col("c")).otherwise(0)).alias("hi"), F.sum(F.when(high == 0, F.col("c")).otherwise(0)).alias("lo"))
            over = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
            ahead = by_x.groupBy("p", "b").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo"))
            ahead = ahead.select(F.col("p").alias("p2"), F.col("b").alias("b2"), *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_ahead") for c in ("hi", "lo")])
            w = Window.partitionBy("p", "b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
            before = lambda c, w=w: F.col(f"{c}_ahead") + F.coalesce(F.sum(c).over(w), F.lit(0))
            one = by_x.join(ahead, (F.col("p") == F.col("p2")) & (F.col("b") == F.col("b2"))).select((F.col("hi") * before("lo") - F.col("lo") * before("hi")).alias("s"))
            parts = one if parts is None else parts.unionByName(one)
        score = parts.agg(F.sum("s").alias("s"))
    return score.crossJoin(total).select((F.coalesce("s", F.lit(0.0)) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))  # one row each


def coefficients(table: Table, names: list[str], kind: str) -> DataFrame:
    """One row: c0_1, c0_2, ... for pairs of names.  Pearson takes one pass for all pairs."""
    pairs = list(combinations(range(len(names)), 2))
    if kind == "pearson":
        df = _numeric(table, names)
        return df.agg(*[F.corr(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])
    if kind not in ("spearman", "kendall"):
        raise StatisticsError(f"Unknown correlation {kind!r}")
    out = None
    nulls = any(f.nullable for f in table.schema if f.name in names)
    ranked = None
    for i, j in pairs:
        if kind == "kendall":
            one = kendall(_numeric(table, names), f"x{i}", f"x{j}").select(F.col("tau").alias(f"c{i}_{j}"))
        elif nulls and _has_nulls(table, names):
            one = _pairwise_ranked(table, names[i], names[j]).agg(F.corr("x0", "x1").alias(f"c{i}_{j}"))
        else:
            ranked = ranked if ranked is not None else _ranked(table, names)
            one = None
        if one is not None:
            out = one if out is None else out.crossJoin(one)  # one row each
    if ranked is not None:
        one = ranked.agg(*[F.corr(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])
        out = one if out is None else out.crossJoin(one)
    return out


def _has_nulls(table: Table, names: list[str]) -> bool:
    test = F.lit(False)
    for n in names:
        test = test | quoted(n).isNull()
    return bool(table.df.where(test).take(1))


def correlations(table: Table, columns: str | None = None, kind: str = "pearson", digits: int = 4, tests: bool = False) -> DataFrame:
    """column1, column2, correlation of each pair; ``tests`` adds p_fisher, p_t and p_chi2 (small driver-side work on one row)."""
    names = _names(table, columns)
    pairs = list(combinations(range(len(names)), 2))
    row = coefficients(table, names, kind)
    if not tests:
        cells = [F.struct(F.lit(names[i]).alias("column1"), F.lit(names[j]).alias("column2"), F.round(F.col(f"c{i}_{j}"), digits).alias("correlation")) for i, j in pairs]
        return row.select(F.inline(F.array(*cells)))
    counts = table.df.agg(*[F.count(F.when(quoted(names[i]).isNotNull() & quoted(names[j]).isNotNull(), 1)).alias(f"n{i}_{j}") for i, j in pairs]).first()
    got = row.first()
    out = [(names[i], names[j], None if (r := got[f"c{i}_{j}"]) is None else round(r, digits), *p_values(r, counts[f"n{i}_{j}"])) for i, j in pairs]
    return table.rows.sparkSession.createDataFrame(out, "column1 string, column2 string, correlation double, p_fisher double, p_t double, p_chi2 double")


def p_values(r: float | None, n: int) -> tuple[float | None, float | None, float | None]:
    """Fisher's z, Student's t and chi-squared tests of r = 0; None for fewer than four rows."""
    if r is None or n < 4:
        return None, None, None
    if abs(r) >= 1:
        return 0.0, 0.0, 0.0
    z = 0.5 * math.log((1 + r) / (1 - r)) * math.sqrt(n - 3)
    t = r * math.sqrt((n - 2) / (1 - r * r))
    return normal_two_sided(z), student_two_sided(t, n - 2), chi2_one(t * t)


def matrix(table: Table, columns: str | None = None, kind: str = "pearson", digits: int = 4) -> DataFrame:
    """variable and corr_with_<column> for every pair, rows by name; each pair is computed once."""
    names = sorted(_names(table, columns))
    row = coefficients(table, names, kind)

    def cell(i, j):
        return F.lit(1.0) if i == j else F.round(F.col(f"c{min(i, j)}_{max(i, j)}"), digits)

    lines = [F.struct(F.lit(n).alias("variable"), *[cell(i, j).alias("corr_with_" + m.replace(".", "_")) for j, m in enumerate(names)]) for i, n in enumerate(names)]
    return row.select(F.inline(F.array(*lines)))
