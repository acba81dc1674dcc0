"""Row identity: where a row stands in its file or in a given order.

No plan here puts all rows through one task.  Parquet rows carry their index
from the scan; other sources are numbered by partition; an order by row number or
hash is numbered in two levels: counts per block (a small table) and a numbering
inside each block; a sort is written once in ranges, which are then files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RID = "__rid"
BLOCK = 1 << 17


def from_parquet(df: DataFrame) -> DataFrame:
    """``df``, read from Parquet, with RID: 1-based, files in path order.  Free for one file; several cost a count of each."""
    if len(df.inputFiles()) <= 1:
        return df.select("*", (F.col("_metadata.row_index") + 1).alias(RID))
    files = df.select(F.col("_metadata.file_path").alias("__f")).groupBy("__f").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("__f", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = df.select("*", F.col("_metadata.row_index").alias("__i"), F.col("_metadata.file_path").alias("__f"))
    return rows.join(files, "__f").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__i") + 1).alias(RID))


def by_partition(df: DataFrame) -> DataFrame:
    """``df``, straight from a scan, with RID in scan order (partition by partition)."""
    rows = df.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__p", part).join(F.broadcast(sizes), "__p")  # one row a partition
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1).alias(RID))


def numbered(df: DataFrame, block: Column, block_order: Column, order: list[Column], name: str = RID) -> DataFrame:
    """``df`` with a dense 1-based ``name`` in the order given by (block_order, order).

    ``block`` cuts the order into contiguous pieces; ``block_order`` sorts the
    pieces.  Rows meet only those of their block.
    """
    rows = df.withColumn("__b", block)
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(block_order).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__b").alias("__b2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    rows = rows.join(sizes, F.col("__b").eqNullSafe(F.col("__b2")))
    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    return rows.select(*keep, (F.col("__before") + F.col("__r")).cast("long").alias(name))


def dense(df: DataFrame) -> DataFrame:
    """RID made dense again after rows were dropped."""
    return numbered(df, F.floor((F.col(RID) - 1) / BLOCK), F.col("__b"), [F.col(RID)])


def shuffled_key(seed: int, rid: str = RID) -> Column:
    """A seeded, reproducible random order of rows, whatever their partitions."""
    return F.md5(F.concat(F.col(rid).cast("string"), F.lit(str(seed))))


def by_hash(df: DataFrame, seed: int, name: str = RID) -> DataFrame:
    """``df`` numbered in the order of ``shuffled_key``; blocks are the key's first three digits."""
    rows = df.withColumn("__h", shuffled_key(seed))
    return numbered(rows, F.substring("__h", 1, 3), F.col("__b"), [F.col("__h"), F.col(RID)], name).drop("__h")
