"""Tables that cut lineage, in the shared folder that the cluster names.

A written table is computed once (a checkpoint of a DataFrame computes its last
stage twice) and, unlike local checkpoints, survives the loss of executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridsmith.plans.store import shared_folder


def fresh(taken: list[str], *names: str) -> tuple[str, ...]:
    """The names, each lengthened until no column in ``taken`` has it (Spark compares without case)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


class Scratch:
    """Written tables of one query; ``drop`` those that nothing lazy reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0
        self.kept: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df, path in [x for x in self.kept if any(x[0] is t for t in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
            self.kept = [x for x in self.kept if x[0] is not df]

    def last(self, df: DataFrame) -> DataFrame:
        """``df`` kept, and all other tables dropped."""
        out = self.keep(df)
        self.drop(*[x for x, _ in self.kept if x is not out])
        return out
