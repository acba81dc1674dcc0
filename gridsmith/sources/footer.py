"""What Parquet footers say: metadata reports without reading data.

Footers are read through Spark's own file listing and the Hadoop filesystem, so
any path that Spark can read will do; only the footer's bytes reach the driver.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from gridsmith.errors import FileError, UnsupportedFormat

MAX_FOOTER = 256 << 20


def _read_range(spark: SparkSession, path: str, start: int, n: int) -> bytes:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    finally:
        stream.close()


def footer(spark: SparkSession, path: str) -> pq.FileMetaData:
    """The metadata of one Parquet file."""
    if not path.lower().endswith(".parquet"):
        raise UnsupportedFormat(f"metadata needs a Parquet file, not {path}")
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
        tail = _read_range(spark, path, size - 8, 8)
        n = int.from_bytes(tail[:4], "little")
        if tail[4:] != b"PAR1" or n > min(size, MAX_FOOTER):
            raise FileError(f"{path} is not a Parquet file")
        return pq.read_metadata(pa.BufferReader(b"PAR1" + _read_range(spark, path, size - 8 - n, n + 8)))
    except FileError:
        raise
    except Exception as e:
        raise FileError(f"Cannot read the footer of {path}: {e}") from e


def count(spark: SparkSession, path: str) -> int:
    return footer(spark, path).num_rows


def _ratio(part: int, whole: int) -> str:
    return f"{100 * part / whole:.2f}%" if whole else "N/A"


def _chunks(meta: pq.FileMetaData):
    for i in range(meta.num_row_groups):
        group = meta.row_group(i)
        for j in range(group.num_columns):
            yield i, j, group.column(j)


def basic(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    packed = sum(c.total_compressed_size for _, _, c in _chunks(meta))
    plain = sum(c.total_uncompressed_size for _, _, c in _chunks(meta))
    extra = {k.decode(): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}
    out = [("file_version", meta.format_version), ("created_by", meta.created_by or "N/A"), ("total_rows", meta.num_rows), ("num_row_groups", meta.num_row_groups), ("num_columns", meta.num_columns), ("total_compressed_size", packed), ("total_uncompressed_size", plain), ("compression_ratio", _ratio(packed, plain)), ("schema_name", "schema"), ("schema_num_fields", len(meta.schema.to_arrow_schema())), ("key_value_metadata_count", len(extra))]
    return [(k, str(v)) for k, v in out] + [(f"metadata_{k}", v) for k, v in extra.items()]


def schema(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    out = []
    for i in range(meta.num_columns):
        c = meta.schema.column(i)
        for k, v in (("name", c.path), ("physical_type", c.physical_type), ("logical_type", c.logical_type.type), ("max_definition_level", c.max_definition_level), ("max_repetition_level", c.max_repetition_level), ("is_optional", str(c.max_definition_level > 0).lower()), ("converted_type", c.converted_type), ("precision", c.precision), ("scale", c.scale), ("length", c.length)):
            out.append((f"column_{i}_{k}", str(v)))
    return out


def row_groups(meta: pq.FileMetaData, detailed: bool = False) -> list[tuple[str, str]]:
    out = []
    for i in range(meta.num_row_groups):
        g = meta.row_group(i)
        packed = sum(g.column(j).total_compressed_size for j in range(g.num_columns))
        rows = [("num_rows", g.num_rows), ("total_byte_size", g.total_byte_size), ("compressed_size", packed), ("num_columns", g.num_columns), ("compression_ratio", _ratio(packed, g.total_byte_size))]
        if detailed and g.num_columns:
            rows += [("first_page_offset", g.column(0).data_page_offset)]
        out += [(f"row_group_{i}_{k}", str(v)) for k, v in rows]
    return out


def column_chunks(meta: pq.FileMetaData, detailed: bool = False) -> list[tuple[str, str]]:
    out = []
    for i, j, c in _chunks(meta):
        rows = [("path", c.path_in_schema), ("type", c.physical_type), ("encodings", ",".join(c.encodings)), ("compression", c.compression), ("uncompressed_size", c.total_uncompressed_size), ("compressed_size", c.total_compressed_size), ("num_values", c.num_values), ("compression_ratio", _ratio(c.total_compressed_size, c.total_uncompressed_size))]
        s = c.statistics if c.is_stats_set else None
        if s is not None:
            rows += [("null_count", s.null_count if s.has_null_count else "N/A"), ("distinct_count", s.distinct_count if s.has_distinct_count else "N/A")]
            if s.has_min_max:
                rows += [("min", s.min), ("max", s.max)]
        if detailed:
            rows += [("data_page_offset", c.data_page_offset), ("dictionary_page_offset", c.dictionary_page_offset if c.has_dictionary_page else "N/A"), ("bloom_filter_offset", "N/A")]
        out += [(f"rg_{i}_col_{j}_{k}", str(v)) for k, v in rows]
    return out


def compression(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    by: dict[str, list[int]] = {}
    for _, _, c in _chunks(meta):
        t = by.setdefault(c.compression, [0, 0, 0])
        t[0] += c.total_compressed_size
        t[1] += c.total_uncompressed_size
        t[2] += 1
    out = []
    for codec, (a, b, n) in sorted(by.items()):
        out += [(f"compression_{codec}_{k}", str(v)) for k, v in (("compressed_size", a), ("uncompressed_size", b), ("chunk_count", n), ("ratio", _ratio(a, b)))]
    return [*out, ("overall_compression_ratio", _ratio(sum(t[0] for t in by.values()), sum(t[1] for t in by.values())))]


def encodings(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    used = Counter(e for _, _, c in _chunks(meta) for e in c.encodings)
    total = sum(used.values())
    return [(f"encoding_{e}_{k}", str(v)) for e, n in sorted(used.items()) for k, v in (("usage_count", n), ("percentage", _ratio(n, total)))]


def statistics(meta: pq.FileMetaData) -> list[tuple[str, str]]:
    every = [c for _, _, c in _chunks(meta)]
    have = [c.statistics for c in every if c.is_stats_set]
    nulls = [s.null_count for s in have if s.has_null_count]
    return [("statistics_total_chunks", str(len(every))), ("statistics_with_statistics", str(len(have))), ("statistics_coverage", _ratio(len(have), len(every))), ("statistics_total_null_count", str(sum(nulls))), ("statistics_chunks_with_distinct_count", str(sum(s.has_distinct_count for s in have)))]


PARTS = {"schema": schema, "row_groups": row_groups, "column_chunks": column_chunks, "compression": compression, "encoding": encodings, "statistics": statistics}


def metadata(spark: SparkSession, path: str, parts: tuple[str, ...] = (), every: bool = False, detailed: bool = False) -> DataFrame:
    """(key, value) rows: the basics, then the asked parts (names of PARTS, or ``every``)."""
    meta = footer(spark, path)
    rows = basic(meta)
    for name, part in PARTS.items():
        if every or name in parts:
            rows += part(meta, detailed) if name in ("row_groups", "column_chunks") else part(meta)
    return spark.createDataFrame(rows, "key string, value string")
