"""Reading tables by file extension, and writing them as one file or a folder."""

from __future__ import annotations

import json
import math
import os
import uuid
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridsmith.errors import FileError, InvalidArgument, UnsupportedFormat
from gridsmith.frame import Table, quoted
from gridsmith.plans import rowid
from gridsmith.sources import xlsx

FORMATS = {"parquet": "parquet", "csv": "csv", "json": "json", "xlsx": "xlsx"}
#: Rows of an Excel sheet that may pass through the driver.
XLSX_ROWS = xlsx.LIMIT_ROWS
CODECS = ("uncompressed", "snappy", "gzip", "zstd", "lz4")


def format_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lstrip(".")
    if ext not in FORMATS:
        raise UnsupportedFormat(path)
    return FORMATS[ext]


def _widened(df: DataFrame) -> DataFrame:
    """Inferred ints as longs, so that CSV and JSON columns have the types that other readers infer."""
    return df.select(*[quoted(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else quoted(f.name) for f in df.schema])


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> Table:
    """The table of a file or folder, its rows in file order.

    ``schema`` spares CSV and JSON the pass that infers types.
    """
    fmt = fmt or format_of(path)
    try:
        if fmt == "parquet":
            return Table(rowid.from_parquet(spark.read.parquet(path)))
        if fmt == "csv":
            reader = spark.read.option("header", True)
            df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
        elif fmt == "json":
            df = (spark.read.schema(schema) if schema else spark.read).json(path)
        elif fmt == "xlsx":
            df = xlsx.read(spark, path)
        else:
            raise UnsupportedFormat(fmt)
    except AnalysisException as e:
        raise FileError(f"Cannot read {path}: {e}") from e
    return Table(rowid.by_partition(df if schema else _widened(df)))


def write(table: Table | DataFrame, path: str, fmt: str | None = None, single_file: bool = False, options: dict | None = None) -> None:
    """Write a table; the format is ``fmt``, else the extension's, else Parquet.

    ``path`` is a folder of parts, written in parallel; ``single_file`` makes it one
    file (all rows through one task, for small results, as the command line does).
    """
    df = table.df if isinstance(table, Table) else table
    ext = os.path.splitext(path)[1].lstrip(".")
    fmt = fmt or FORMATS.get(ext, "parquet")
    if fmt == "xlsx":
        rows = df.limit(XLSX_ROWS + 1).toLocalIterator(prefetchPartitions=False)
        xlsx.write(df.columns, (tuple(r) for r in rows), path)
        return
    if fmt not in FORMATS:
        raise UnsupportedFormat(fmt)
    target = path if not single_file else f"{path}.{uuid.uuid4().hex}.tmp"
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite").options(**(options or {}))
    if fmt == "csv":
        out.option("header", True).csv(target)
    elif fmt == "json":
        out.option("ignoreNullFields", False).json(target)
    else:
        out.parquet(target)
    if single_file:
        _only_part(df.sparkSession, target, path)


def _only_part(spark: SparkSession, folder: str, path: str) -> None:
    """Move the one part file of a written folder to ``path``, on whatever filesystem it is."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(a) if s.getPath().getName().startswith("part-"))
    if fs.exists(b):
        fs.delete(b, True)
    fs.rename(part, b)
    fs.delete(a, True)


def convert(spark: SparkSession, source: str, target: str, single_file: bool = False) -> None:
    write(read(spark, source), target, single_file=single_file)


def optimize_options(compression: str = "snappy", level: int = 6, dictionary: bool | None = None, block_bytes: int | None = None) -> dict[str, str]:
    """Checked writer options; snappy and lz4 have no levels."""
    if not 1 <= level <= 9:
        raise InvalidArgument("Compression level must be between 1 and 9")
    if compression not in CODECS:
        raise InvalidArgument(f"Unsupported compression {compression!r}")
    out = {"compression": compression}
    if compression == "zstd":
        out["parquet.compression.codec.zstd.level"] = str(level)
    elif compression == "gzip":
        out["zlib.compress.level"] = ("BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")[level - 1]
    if dictionary is not None:
        out["parquet.enable.dictionary"] = str(dictionary).lower()
    if block_bytes:
        out["parquet.block.size"] = str(block_bytes)
    return out


def optimize(spark: SparkSession, source: str, target: str | None = None, compression: str = "snappy", level: int = 6, sort_by: str | None = None, row_group_size: int = 1_000_000, dictionary: bool = False, no_dictionary: bool = False, validate: bool = False, single_file: bool = False) -> str:
    """Rewrite a table as Parquet, sorted (nulls first) and encoded as asked; returns the path.

    Row groups are sized by bytes: ``row_group_size`` rows times the estimated row width.
    """
    from gridsmith.operators.sizes import width_bytes
    from gridsmith.operators.sorting import sort

    if dictionary and no_dictionary:
        raise InvalidArgument("Cannot specify both --dictionary and --no-dictionary")
    table = read(spark, source)
    block = max(1 << 20, row_group_size * sum(width_bytes(f.dataType, 8) for f in table.schema.fields) // 8)
    options = optimize_options(compression, level, True if dictionary else False if no_dictionary else None, min(block, 1 << 30))
    if sort_by:
        table = sort(table, sort_by, nulls="first")
    target = target or os.path.splitext(source)[0] + "_optimized.parquet"
    write(table, target, "parquet", single_file, options)
    if validate and (a := table.rows.count()) != (b := spark.read.parquet(target).count()):
        raise FileError(f"Validation failed: {a} rows in, {b} rows out")
    return target


def json_lines(rows: Iterable[dict]) -> Iterator[str]:
    """The lines of a JSON array of rows, one row at a time; non-finite numbers are null."""

    def clean(v):
        if isinstance(v, float) and not math.isfinite(v):
            return None
        return v if isinstance(v, (int, float, str, bool, type(None), list, dict)) else str(v)

    last = None
    for r in rows:
        yield "[" if last is None else last + ","
        last = "  " + json.dumps({k: clean(v) for k, v in r.items()}, ensure_ascii=False, indent=2).replace("\n", "\n  ")
    yield from ["[]"] if last is None else [last, "]"]


def json_array(rows: Iterable[dict]) -> str:
    return "\n".join(json_lines(rows))
