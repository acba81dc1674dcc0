"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue (by a seeded hash of doc_id) and
may pass through it ``cap`` times.  A document is served in packets of PACKET words.
A packet's virtual finish time is its source's words up to and including it, over
all passes, divided by the source's target.  All packets are then sorted by finish
time, globally, and the order is cut where its words reach the total budget: what
stands before the cut is taken, and of the packet at the cut the part that fits.
Queues served in this order advance in proportion to their targets, to a packet.
``op2`` takes a document's words before the cut; ``mixture`` takes it whole if at
least half of them are before it.

Targets: ``ratio`` times all words, shared by weight, each stopped at ``cap``
times its source's words, the excess reshared by weight among the others.

Nothing is sorted in one task.  Running sums inside a queue are per source and hash
bucket, over at most 16**BUCKET_DIGITS buckets of a source, and rows are ordered
only within theirs, with equal rows counted as one; so a hot source is spread over
thousands of groups.  The global order is a range partition by finish time: words
are summed for RANGES ranges at a time (packets are made and summed where their
document is, and never shuffled), the range that holds the cut is divided again
until it has at most SORTED packets, and only these are ordered.  The per-source
table is broadcast only if it has at most SMALL_SOURCES rows (counted), else joined
by a shuffle; one row a source goes through the window that shares out targets.

Nulls: a null source is a source of its own, last in order; null and empty texts
have size 0 and take nothing; a null doc_id is told by its text.  Repeated rows each
count, and stand behind one another.  An empty table, or one with no words, gives
targets of 0.  Columns of any names stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import table
from gridsmith.llm.scratch import Scratch, fresh

#: Fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RATIO, CAP = 1.5, 2
SEED = 17
PACKET = 64
BUCKET_DIGITS = 3
RANGES, SORTED = 1024, 10_000
SMALL_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """What a queue is shuffled by: a digest of doc_id, or of the text where it is null."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit(""))))), F.lit(f"-{seed}")))


def sizes_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and key of each row of ``docs``; the one time that texts are read."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", size_of(text).alias("size"), shuffle_key(F.col("doc_id"), text, seed).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """source, source_size, target for rows of (source, size).  One row a source goes through the ordering windows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    rising = Window.orderBy("level", "place").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", F.col("most") / F.col("weight"))
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(ratio)))
    left = F.col("budget") - F.coalesce(F.sum("most").over(rising), F.lit(0.0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    per = per.withColumn("full", F.col("level") * open_ <= left)
    spent = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise((F.col("budget") - spent) / F.when(share > 0, share) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _joined(df: DataFrame, per_source: DataFrame, source: str = "source") -> DataFrame:
    """``df`` with the per-source columns; the source table is broadcast only if it is counted to be small."""
    (other,) = fresh([*df.columns, *per_source.columns], "source")
    small = per_source.withColumnRenamed("source", other)
    if small.count() <= SMALL_SOURCES:
        small = F.broadcast(small)
    return df.join(small, F.col(f"`{source}`").eqNullSafe(F.col(other))).drop(other)


def schedule(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """The queues: doc_id, source, size, key, source_size, target, copy (its number among equal
    rows), copies, before (the source's words ahead of it) and finish, the time at which its first pass ends.

    ``sizes`` is as ``sizes_of`` gives it.
    """
    rows = sizes.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    words = F.col("size") * F.col("copies")
    sums = rows.groupBy("source", "bucket").agg(F.sum(words).alias("words"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), ahead.alias("ahead"))
    own = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(own), F.lit(0)))
    rows = rows.join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    before = F.col("ahead") + F.col("inside") + F.col("copy") * F.col("size")
    rows = _joined(rows.select("doc_id", "source", "size", "key", "copy", "copies", before.alias("before")), targets(sizes, weights, ratio, cap))
    return rows.withColumn("finish", (F.col("before") + F.col("size")) / F.when(F.col("target") > 0, F.col("target")))


def _place(passed: Column) -> Column:
    """The order of packets that finish at one time."""
    return F.struct(F.col("key"), F.col("size"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), passed.alias("pass"), F.col("before"))


def _packets(passed: Column) -> Column:
    """The packets of a document's pass: their last word, number of words and finish time."""
    last = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("size") / PACKET)).cast("int"))

    def packet(j: Column) -> Column:
        end = F.least(j * PACKET, F.col("size"))
        return F.struct((end - (j - 1) * PACKET).alias("words"), ((F.col("before") + F.col("source_size") * passed + end) / F.col("target")).alias("time"))

    return F.transform(last, packet)


def cut_at(queues: DataFrame, budget: float, latest: float, cap: int = CAP) -> tuple[float, tuple | None, int]:
    """Where the packets, sorted by finish time, reach ``budget`` words: (time, place, words) of
    the packet at the cut and how many of its words fit.  ``latest`` is no less than any time."""
    served = queues.where("size > 0 AND target > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(cap)))))
    low, high, left = 0.0, latest, int(budget)
    while True:
        # documents in service within the range
        start = (F.col("before") + F.col("source_size") * F.col("pass")) / F.col("target")
        within = served.where((start <= high + 1e-9) & (start + F.col("size") / F.col("target") >= low - 1e-9))
        packets = within.select("*", F.explode(_packets(F.col("pass"))).alias("p")).where((F.col("p.time") >= low) & (F.col("p.time") <= high))
        width = (high - low) / RANGES
        at = F.floor((F.col("p.time") - low) / width)
        found = sorted((int(r["at"]), int(r["words"]), r["n"], r["lo"], r["hi"]) for r in packets.groupBy(at.alias("at")).agg(F.sum("p.words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("p.time").alias("lo"), F.max("p.time").alias("hi")).collect())
        for _, words, n, lo, hi in found:
            if left < words:
                break
            left -= words
        else:
            return high, None, 0  # all fit
        if n <= SORTED or lo == hi:
            break
        low, high = lo, hi
        if hi - lo <= 1e-12 * hi:  # as near as times can be told apart
            break
    rows = packets.where((F.col("p.time") >= lo) & (F.col("p.time") <= hi)).select(F.col("p.time").alias("time"), _place(F.col("pass")).alias("place"), F.col("p.words").alias("words"))
    for time, place, words in sorted((r["time"], tuple(r["place"]), r["words"]) for r in rows.collect()):
        if left < words:
            return time, place, left
        left -= words
    raise AssertionError("the cut is in this range")


def taken_words(cut: tuple[float, tuple | None, int], passed: int) -> Column:
    """Words before the cut of a row of ``schedule`` in one pass."""
    time, place, part = cut
    begun = (F.col("before") + F.col("source_size") * passed) / F.col("target")
    over = (F.col("before") + F.col("source_size") * passed + F.col("size")) / F.col("target")
    if place is None:
        at_cut = lambda p: F.when(p["time"] <= time, p["words"])
    else:
        mine = _place(F.lit(passed))
        cut_place = F.struct(F.lit(place[0]).alias("key"), F.lit(place[1]).cast("long").alias("size"), F.lit(place[2]).alias("none"), F.lit(place[3]).alias("source"), F.lit(place[4]).alias("pass"), F.lit(place[5]).cast("long").alias("before"))
        at_cut = lambda p: F.when((p["time"] < time) | (p["time"] == time) & (mine < cut_place), p["words"]).when((p["time"] == time) & (mine == cut_place), F.lit(part).cast("long"))
    inside = F.aggregate(_packets(F.lit(passed)), F.lit(0).cast("long"), lambda acc, p: acc + F.coalesce(at_cut(p), F.lit(0)))
    return F.when((F.col("size") == 0) | F.coalesce(F.col("target") <= 0, F.lit(True)) | (begun > time), F.lit(0)).when(over < time, F.col("size")).otherwise(inside).cast("long")


def served(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    """``schedule`` rows with taken0, taken1, ...: the words before the cut in each pass."""
    queues = scratch.keep(schedule(sizes, weights, ratio, cap))
    most = queues.where("target > 0").agg(F.max(F.col("source_size") * cap / F.col("target")).alias("latest")).first()["latest"]
    words = sizes.agg(F.sum("size").alias("words")).first()["words"]
    cut = cut_at(queues, ratio * int(words or 0), float(most), cap) if most else (0.0, None, 0)
    return queues.withColumns({f"taken{p}": taken_words(cut, p) for p in range(cap)})


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, cap: int = CAP, seed: int = SEED, ordered: bool = False) -> DataFrame:
    """The mix itself: ``docs`` (doc_id, source, text and more), each as often as the mix takes it.

    Whole documents only: a pass is taken if at least half of its words are before
    the cut.  Since a queue is taken from its front, each source's decision is one
    place in its order (and of equal rows there, how many), so texts are filtered
    where they are and not shuffled.  ``ordered`` sorts the result by virtual finish
    time (a range sort of the texts).
    """
    scratch = Scratch(docs.sparkSession)
    sizes = scratch.keep(sizes_of(docs, seed))
    rows = served(sizes, scratch, weights, ratio, cap)
    last = lambda c: F.struct("key", "doc_id", "size", c.alias("copy"), F.col("copies"))
    fits = [(F.col("size") > 0) & (F.col(f"taken{p}") * 2 >= F.col("size")) for p in range(cap)]
    cuts = rows.groupBy("source").agg(*[F.max(F.when(f, last(F.col("copy")))).alias(f"cut{p}") for p, f in enumerate(fits)], F.max("source_size").alias("words"), F.max("target").alias("target"))
    mine, cut, number, passed, at = fresh(docs.columns, "mine", "cut", "number", "pass", "at")
    text = F.col("text").cast("string")
    place = F.struct(shuffle_key(F.col("doc_id"), text, seed).alias("key"), F.col("doc_id"), size_of(text).alias("size"))
    cuts = scratch.keep(cuts.select("source", F.struct(*[c for c in cuts.columns if c != "source"]).alias(cut)))
    out = _joined(docs.withColumn(mine, place), cuts)
    end = lambda p: F.struct(*[F.col(f"{cut}.cut{p}.{c}").alias(c) for c in ("key", "doc_id", "size")])
    there = lambda p: F.col(f"{cut}.cut{p}").isNotNull() & (F.col(mine) == end(p))
    # of equal rows at a cut, of which only some are taken, each has a number; elsewhere none is needed
    in_part = lambda p: F.col(f"{cut}.cut{p}.copy") < F.col(f"{cut}.cut{p}.copies") - 1
    if cuts.where(reduce(lambda a, b: a | b, [F.coalesce(in_part(p), F.lit(False)) for p in range(cap)])).take(1):
        some = reduce(lambda a, b: a | b, [F.coalesce(there(p) & in_part(p), F.lit(False)) for p in range(cap)])
        parted = scratch.keep(out.where(some))
        out = out.where(~some).withColumn(number, F.lit(0).cast("long")).unionByName(_numbered(parted, mine, number))
    else:
        out = out.withColumn(number, F.lit(0).cast("long"))
    takes = [F.col(f"{cut}.cut{p}").isNotNull() & (F.col(f"{mine}.size") > 0) & ((F.col(mine) < end(p)) | there(p) & (F.col(number) <= F.col(f"{cut}.cut{p}.copy"))) for p in range(cap)]
    passes = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(p)) for p, t in enumerate(takes)]))
    out = out.withColumn(passed, F.explode(passes))
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not ordered:
        return out.select(*own)
    of_key, of_doc, of_source, before = fresh(out.columns, "of_key", "of_doc", "of_source", "before")
    starts = rows.groupBy(F.col("key").alias(of_key), F.col("doc_id").alias(of_doc), F.col("source").alias(of_source), F.col("size").alias(at)).agg(F.min("before").alias(before))
    same = (F.col(f"{mine}.key") == F.col(of_key)) & F.col(f"{mine}.doc_id").eqNullSafe(F.col(of_doc)) & F.col("source").eqNullSafe(F.col(of_source)) & (F.col(f"{mine}.size") == F.col(at))
    end_time = (F.col(before) + (F.col(number) + 1) * F.col(at) + F.col(f"{cut}.words") * F.col(passed)) / F.col(f"{cut}.target")
    return out.join(starts, same).orderBy(end_time, F.col(of_key)).select(*own)


def _numbered(rows: DataFrame, by: str, number: str) -> DataFrame:
    """``rows`` of a written table with their number, from 0, among those equal in ``by``: counts by
    input partition, then numbers inside it, so that no group goes through one task."""
    part, at, ahead, n, of_part, of_by = fresh(rows.columns, "part", "at", "ahead", "n", "of_part", "of_by")
    rows = rows.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(F.col(at), 33))
    counts = rows.groupBy(F.col(by).alias(of_by), F.col(part).alias(of_part)).agg(F.count(F.lit(1)).alias(n))
    counts = counts.select(of_by, of_part, F.coalesce(F.sum(n).over(Window.partitionBy(of_by).orderBy(of_part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(by, part).orderBy(at)) - 1)
    return rows.join(counts, F.col(by).eqNullSafe(F.col(of_by)) & (F.col(part) == F.col(of_part))).withColumn(number, F.col(number) + F.col(ahead)).drop(part, at, ahead, of_part, of_by)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: how many words the mix takes of each document."""
    scratch = Scratch(spark)
    sizes = scratch.keep(sizes_of(table(spark, sf_dir, "documents")))
    rows = served(sizes, scratch)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("taken0") + F.col("taken1")).alias("taken"), "finish")


ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, ''))) || '-{SEED}') AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s),
v AS (
  SELECT source, source_size, place, [5.0, 2.0, 1.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM w),
x AS (
  SELECT *, most / weight * (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) <= budget - coalesce(sum(most) OVER r, 0) AS is_full
  FROM v WINDOW r AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, budget, CASE WHEN is_full THEN most ELSE
    (budget - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) * weight END AS target FROM x),
q AS MATERIALIZED (
  SELECT rid, doc_id, d.source, key, size, source_size, target, budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
packet AS (
  SELECT rid, key, size, source, pass, ahead, budget, least(j * {PACKET}, size) - (j - 1) * {PACKET} AS words,
         (ahead + source_size * pass + least(j * {PACKET}, size)) / target AS finish
  FROM (SELECT *, unnest(range(1, (size + {PACKET} - 1) // {PACKET} + 1)) AS j FROM q, range({CAP}) AS passes(pass) WHERE size > 0 AND target > 0)),
run AS (
  SELECT rid, words, floor(budget)::BIGINT AS budget,
         sum(words) OVER (ORDER BY finish, key, size, source NULLS LAST, pass, ahead, words DESC ROWS UNBOUNDED PRECEDING) AS served FROM packet),
taken AS (SELECT rid, sum(greatest(0, least(words, budget - (served - words)))) AS taken FROM run GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, (ahead + size) / nullif(target, 0) AS finish
FROM q LEFT JOIN taken ON q.rid = taken.rid
"""
