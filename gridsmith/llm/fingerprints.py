"""Document fingerprints by Order MinHash, with an edited copy and the next document.

``fingerprint`` gives each text M sketch values of ELL ordered minima over
occurrence-numbered five-word k-mers, as hex.  ``with_next`` also compares each
document with its neighbour in descending doc_id order and with an edited text
made of both.

The neighbour order is global, but nothing is gathered in one task or on the
driver: rows go once through an exchange by doc_id range (as compressed bytes),
each task walks its sorted range with one row of look-ahead, and the first row
of each range is sent to the range before it as well.  Rows that share a doc_id, or
have none, are cut further by their text's digest.  The driver sees only one
(doc_id, digest) per range.

Null texts are empty; a text without words has the all-zero fingerprint, and two
such are alike.  Rows with equal doc_id are ordered by their text's digest; null
doc_ids come last.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, map_batches, slices, table
from gridsmith.llm.omh import K, Shingler, Sketcher, likeness

M, ELL = 64, 2


def printed(sketch: np.ndarray) -> np.ndarray:
    """The sketch as kept: 32 bits of each value, in network order."""
    return (sketch >> np.uint64(32)).astype(">u4")


def hexed(kept: np.ndarray) -> str:
    return kept.tobytes().hex()


def near(a: np.ndarray, b: np.ndarray, ell: int = ELL) -> float:
    """0 to 1: the share of equal values, to the power 1/ell, since each value stands for ell k-mers in order."""
    return likeness(a, b) ** (1 / ell)


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = M, ell: int = ELL, k: int = K) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row, without a shuffle."""

    def make():
        shingle, sketch = Shingler(k), Sketcher(m, ell)

        def apply(keys, texts):
            return keys, [len(t or "") for t in texts], [hexed(printed(sketch(shingle(t or "")))) for t in texts]

        return apply

    return arrow_map(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), {"doc_id": "long", "n_chars": "long", "fingerprint": "string"}, make)


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the following text, or all it has."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_PACKED = "part int, ahead int, doc_id bigint, digest binary, packed binary"
_OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_LAST = (1 << 63) - 1


def _cuts(ids: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """Cut points of (negated id, first bits of the digest), rising; null ids are last.

    Near quantiles of the ids do: the result is the same for any cuts.  An id that
    many rows have, or null, is cut further by the digest, which is even.
    """
    row = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [1.0], 10 * ranges).alias("cuts"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("known")).first()
    often = Counter(-k for k in row["cuts"] or [])
    if row["rows"] > row["known"]:
        often[_LAST] = max(1, round(ranges * (row["rows"] - row["known"]) / row["rows"]))
    return sorted((k, (j << 64) // n) for k, n in often.items() for j in range(n + (n > 1 and k != _LAST)))


def _place(key: int | None, digest: bytes) -> tuple[int, int]:
    return (_LAST if key is None else -key), int.from_bytes(digest[:8], "big")


def _firsts(rows: DataFrame, cuts: list[tuple[int, int]]) -> dict[int, tuple[int, bytes]]:
    """(negated id, digest) of the first row of each range that has rows; a partial result per task, one row per range in the end."""

    def run(batches):
        best: dict[int, tuple[int, bytes]] = {}
        for batch in batches:
            for part in slices(batch):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    digest = hashlib.md5((t or "").encode()).digest()
                    place = _place(k, digest)
                    p, first = bisect_right(cuts, place), (place[0], digest)
                    if p not in best or first < best[p]:
                        best[p] = first
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([v[0] for v in best.values()], pa.int64()), pa.array([v[1] for v in best.values()], pa.binary())], names=["part", "first", "digest"])

    found = map_batches(rows, run, "part int, first bigint, digest binary").groupBy("part").agg(F.min(F.struct("first", "digest")).alias("m"))
    return {r["part"]: (r["m"]["first"], bytes(r["m"]["digest"])) for r in found.collect()}


def _packed(rows: DataFrame, cuts: list[tuple[int, int]], firsts: dict[int, tuple[int, bytes]]) -> DataFrame:
    """Compressed texts with their range; the first of each range also goes to the range before it, as its look-ahead."""
    full = sorted(firsts)
    before = {p: full[i - 1] for i, p in enumerate(full)}

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        sent: set[int] = set()  # rows that are equal to a first one need no second look-ahead from this task
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(5)]
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (text or "").encode()
                    row = (k, hashlib.md5(data).digest(), pack.compress(data))
                    place = _place(k, row[1])
                    p = bisect_right(cuts, place)
                    to = [(p, 0)]
                    if p not in sent and firsts[p] == (place[0], row[1]):
                        sent.add(p)
                        to.append((before[p], 1))
                    for where in to:
                        for column, value in zip(out, (*where, *row), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "ahead", "doc_id", "digest", "packed"])

    return map_batches(rows, run, _PACKED)


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = M, ell: int = ELL, k: int = K, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    ``ranges`` is the number of doc_id ranges (default: the session's shuffle
    partitions); the result does not depend on it.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cuts = _cuts(rows.select("doc_id"), ranges)
    packed = _packed(rows, cuts, _firsts(rows, cuts))

    def run(batches):
        shingle, sketch = Shingler(k), Sketcher(m, ell)
        open_ = zstandard.ZstdDecompressor()

        def read():
            for batch in batches:
                for part in slices(batch):
                    for p, ahead, key, packed_ in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                        text = open_.decompress(packed_).decode()
                        yield p, ahead, key, text, printed(sketch(shingle(text)))

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, _OUT, strict=True)], names=[n for n, _ in _OUT])

        out: list[list] = [[] for _ in _OUT]
        now = None
        for then in read():
            # a range's rows end with its look-ahead; a task that sent a second one is passed over
            if now is not None and not now[1]:
                changed = edited(now[3], then[3])
                other = printed(sketch(shingle(changed)))
                row = (now[2], len(now[3]), hashlib.sha256(changed.encode()).hexdigest(), hexed(now[4]), hexed(other), near(now[4], other, ell), near(now[4], then[4], ell))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if len(out[0]) >= 1024:
                    yield batch_of(out)
                    out = [[] for _ in _OUT]
            now = then
        if out[0]:
            yield batch_of(out)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    spread = packed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "digest")
    return map_batches(spread, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's fingerprint, its edited text's, and how near they and the next one's are."""
    return with_next(table(spark, sf_dir, "documents"))
