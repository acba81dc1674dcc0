"""Exact counts of values and quantiles of many columns, without all values of a column in one task.

Columns are unpivoted into (column, value) pairs and counted once, with partial
sums.  Quantiles come from ranks: the different values of each column are cut into
ranges at approximate quantiles (a bounded array a column), counts are summed a
range, and values are only ordered in the ranges that hold a wanted rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that a column's different values are cut into.
RANGES = 64


def value_counts(df: DataFrame, columns: list[tuple[Column, T.DataType]]) -> DataFrame:
    """i, v, s and c: how often each non-null value of each column occurs.

    ``v`` is the value as a double (null for text); ``s`` tells apart what doubles
    cannot (text, and integers or decimals of many digits).
    """
    text = F.lit(None).cast("string")
    pairs = []
    for i, (c, kind) in enumerate(columns):
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        number = isinstance(kind, T.NumericType)
        pairs.append(F.struct(F.lit(i).alias("i"), (c.cast("double") if number else F.lit(None).cast("double")).alias("v"), (text if floating else c.cast("string")).alias("s")))
    rows = df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("v IS NOT NULL OR s IS NOT NULL")
    return rows.groupBy("i", "v", "s").agg(F.count(F.lit(1)).alias("c"))


def of_counts(counts: DataFrame, probabilities: list[float]) -> DataFrame:
    """i and q: the interpolated quantiles of each numeric column of ``value_counts``."""
    counts = counts.where("v IS NOT NULL").select("i", "v", "s", "c")
    cuts = counts.groupBy("i").agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("cuts"))
    counts = counts.join(F.broadcast(cuts), "i")  # one bounded row a column
    counts = counts.withColumn("r", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    every, before = Window.partitionBy("i"), Window.partitionBy("i").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("i", "r").agg(F.sum("c").alias("n"))  # at most RANGES rows a column
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(every))
    place = F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("k", "p")
    wanted = sums.select("*", place).withColumn("at", F.col("p") * (F.col("total") - 1))
    wanted = wanted.withColumn("lo", F.floor("at")).withColumn("hi", F.ceil("at"))
    wanted = wanted.where((F.col("ahead") <= F.col("hi")) & (F.col("ahead") + F.col("n") > F.col("lo")))
    ranges = wanted.groupBy("i", "r").agg(F.first("ahead").alias("ahead"), F.collect_list(F.struct("k", "at", "lo", "hi")).alias("wanted"))
    rows = counts.join(F.broadcast(ranges), ["i", "r"])  # at most two ranges a column and quantile
    inside = Window.partitionBy("i", "r").orderBy("v", "s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("ahead") + F.coalesce(F.sum("c").over(inside), F.lit(0)))
    rows = rows.select("i", "v", "start", (F.col("start") + F.col("c")).alias("end"), F.explode("wanted").alias("w"))
    has = lambda rank: (F.col("start") <= F.col(rank)) & (F.col(rank) < F.col("end"))
    found = rows.where(has("w.lo") | has("w.hi")).groupBy("i", F.col("w.k").alias("k")).agg(F.first("w").alias("w"), F.max(F.when(has("w.lo"), F.col("v"))).alias("a"), F.max(F.when(has("w.hi"), F.col("v"))).alias("b"))
    value = F.when(F.col("w.lo") == F.col("w.hi"), F.col("a")).otherwise((F.col("w.hi") - F.col("w.at")) * F.col("a") + (F.col("w.at") - F.col("w.lo")) * F.col("b"))
    return found.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("x")))), lambda x: x["x"]).alias("q"))


def row_of(df: DataFrame, columns: list[Column], probabilities: list[float], accuracy: int | None = None) -> DataFrame:
    """One row with the arrays q0, q1, ... of each column's quantiles (null where it has no values); approximate with ``accuracy``."""
    if accuracy:
        return df.agg(*[F.percentile_approx(c.cast("double"), probabilities, accuracy).alias(f"q{i}") for i, c in enumerate(columns)])
    found = of_counts(value_counts(df, [(c.cast("double"), T.DoubleType()) for c in columns]), probabilities)
    return found.agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(columns))])
