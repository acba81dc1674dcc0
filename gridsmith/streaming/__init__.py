"""Streams: the row-local operators, which hold no state, and windowed frequencies.

A streaming DataFrame goes through the same expression builders as a table; only
counts need state, which a watermark bounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.columns import resolve_list
from gridsmith.frame import quoted
from gridsmith.functions.expressions import assignments, spark_sql
from gridsmith.plans.store import shared_folder
from gridsmith.predicates import conditions


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet file, or a folder to which files are added, as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def pipeline(stream: DataFrame, keep: str | None = None, create: str | None = None, columns: str | None = None) -> DataFrame:
    """Conditions, new columns and a column list, in this order."""
    if keep:
        stream = stream.where(conditions(stream.schema, keep))
    if create:
        stream = stream.select("*", *[F.expr(spark_sql(e)).alias(n) for n, e in assignments(create)])
    return stream.select(*[quoted(c) for c in resolve_list(stream.columns, columns)]) if columns else stream


def frequency(stream: DataFrame, time: str, columns: str, window: str, lateness: str) -> DataFrame:
    """Counts of values in tumbling windows; windows older than the watermark are closed and their state dropped."""
    names = resolve_list(stream.columns, columns)
    stream = stream.withColumn("__t", quoted(time).cast(T.TimestampType())).withWatermark("__t", lateness)
    out = stream.groupBy(F.window("__t", window).alias("__w"), *[quoted(n) for n in names]).agg(F.count(F.lit(1)).alias("frequency"))
    return out.select(F.col("__w.start").cast(T.TimestampNTZType()).alias("window_start"), *[quoted(n) for n in names], "frequency")


def run_to_table(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there now, and give the result as a table.

    Append results go to Parquet files (exactly once, through the checkpoint);
    complete ones, small by nature, to a written table after each batch.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{folder}/rows")
    else:
        writer = writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/rows"))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
