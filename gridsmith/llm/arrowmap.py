"""Row-wise Python stages over Arrow batches, with bounded slices.

``arrow_map`` runs a function over every row of a DataFrame inside
``mapInArrow``.  It shuffles nothing, keeps no state between rows other than
what ``make()`` builds (a cache or a model), and hands the function at most
``SLICE_ROWS`` rows or ``SLICE_BYTES`` of Arrow data at a time, so memory does
not grow with the partition.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
SLICE_ROWS = 512
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch between the JVM and Python; both hold whole batches.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch):
    """The batch in parts of at most SLICE_ROWS rows, smaller where rows are large."""
    rows = max(1, min(SLICE_ROWS, SLICE_ROWS * SLICE_BYTES // max(1, batch.nbytes * SLICE_ROWS // max(1, batch.num_rows))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches, giving Arrow's unused memory back after each task."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BATCHES, str(BATCH_ROWS))

    def released(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


def arrow_map(df: DataFrame, schema: dict[str, str], make: Callable[[], Callable]) -> DataFrame:
    """Apply ``make()`` (called once a task) to slices of ``df``.

    The function made gets one list per column of ``df`` and returns one list
    per column of ``schema`` (name to one of the types in ARROW).  All lists of
    a call have the same length, which may differ from the input's.
    """
    names, kinds = list(schema), [ARROW[t] for t in schema.values()]

    def run(batches):
        apply = make()
        for batch in batches:
            for part in slices(batch):
                out = apply(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return map_batches(df, run, ", ".join(f"`{n}` {'bigint' if t == 'long' else t.replace('long', 'bigint')}" for n, t in schema.items()))
