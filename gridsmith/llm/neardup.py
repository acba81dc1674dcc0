"""Near-duplicate documents by Order MinHash and banded alignment.

Equal texts are one node.  Each node's words become occurrence-labelled five-word
shingles; M sketch values of ELL ordered minima each are its buckets.  Few shingles
are drawn without replacement, which lowers the chance that a sketch agrees, so
texts of up to SHORT shingles have M further buckets of SHORT_ELL minima.  Within a
bucket every node is first aligned with one leader (a different one in each
bucket); links give components; then, exactly, the pairs that are still open are
aligned: nodes of one bucket in different components.  In a bucket of up to
SMALL_BUCKET nodes these are all pairs but those that the triangle inequality with
their leader rules out.  The nodes of larger buckets (texts that share a common
passage fall together in thousands) are aligned with a second, central leader; then
those that are not of the largest component meet the others by exact filters on
their rarest shingles (``_rarely_met``).  So a group of thousands costs a few
alignments a member, and one for each member and stray that may still be alike,
instead of all pairs, and no candidate pair between different texts is lost.

Likeness of two texts: L / (n + m - L), with L the longest common subsequence of
their labelled shingles (n and m of them) inside the band of diagonals that any
text likely enough to matter stays in.  One minus it is a metric.  Texts alike by
at least LIKE are linked, classes are connected components, and a class is named
by its least doc_id.

Null texts are empty.  Texts without words are near copies only of equal texts;
texts of fewer than five words have one shingle.  Null doc_ids are rows like any
other (a class of nothing else has a null id).  Repeated rows are copies.

Texts are never shuffled: a pass makes sketches, and a second pass gives the
shingles of those nodes that share a bucket, found by a broadcast of their ids
only if these are counted to be at most SMALL_IDS, else by a shuffle join.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import map_batches, slices, table
from gridsmith.llm.components import components
from gridsmith.llm.omh import K, Shingler, Sketcher
from gridsmith.llm.scratch import Scratch, fresh

LIKE = 0.8
M, ELL = 24, 4
SHORT, SHORT_ELL = 25, 2
SMALL_IDS = 500_000
SMALL_BUCKET = 16
SENT_DIGESTS = 20_000
#: Slots that shingles are counted in, and the slices that tasks add them up by.
SLOTS, PARTS = 1 << 21, 64


def digest_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def alignment(a: np.ndarray, b: np.ndarray, like: float = LIKE) -> float:
    """Likeness of two sequences of distinct labelled shingles.

    Exact wherever it is at least ``2 * like - 1``; below that it may be an upper
    bound, which is all that the triangle inequality needs.
    """
    n, m = a.size, b.size
    if not n or not m:
        return float(n == m)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    floor = max(0.0, 2 * like - 1)
    bound = i.size / (n + m - i.size)
    if bound < floor:
        return bound
    # texts at distance d = n + m - 2 L stay within d diagonals; beyond this band likeness is below the floor
    band = int((1 - floor) * (n + m) / (1 + floor)) + 1
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if j.size < 2 or bool((np.diff(j) > 0).all()):
        common = j.size
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        common = len(tails)
    return common / (n + m - common)


def _sketched(docs: DataFrame, m: int, ell: int, k: int) -> DataFrame:
    """digest, doc_id and sketch (null without words) of rows of (doc_id, text); equal texts are sketched once a task, as far as memory serves."""

    def run(batches):
        import hashlib

        shingle, sketch, further = Shingler(k), Sketcher(m, ell), Sketcher(m, min(ell, SHORT_ELL), seed=2)
        known: dict[bytes, list[int] | None] = {}
        for batch in batches:
            for part in slices(batch):
                digests, sketches = [], []
                for t in part.column(1).to_pylist():
                    d = hashlib.md5((t or "").encode()).digest()
                    if d not in known:
                        if len(known) >= SENT_DIGESTS:
                            known.clear()
                        s = shingle(t or "")
                        own = [sketch(s)] + ([further(s)] if s.size <= SHORT else [])
                        known[d] = np.concatenate(own).view(np.int64).tolist() if s.size else None
                    digests.append(d.hex())
                    sketches.append(known[d])
                yield pa.RecordBatch.from_arrays([pa.array(digests), part.column(0), pa.array(sketches, pa.list_(pa.int64()))], names=["digest", "doc_id", "sketch"])

    return map_batches(docs, run, "digest string, doc_id bigint, sketch array<bigint>")


def _shingled(rows: DataFrame, k: int) -> DataFrame:
    """node and its labelled shingles (32 bits each) of rows of (node, text)."""

    def run(batches):
        shingle = Shingler(k)
        for batch in batches:
            for part in slices(batch):
                seqs = [(shingle(t or "") >> np.uint64(32)).astype("<u4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(seqs, pa.binary())], names=["node", "seq"])

    return map_batches(rows, run, "node string, seq binary")


def _aligned(pairs: DataFrame, like: float) -> DataFrame:
    """a, b and their likeness for rows of (a, b, seq_a, seq_b)."""

    def run(batches):
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, "<u4"))

        def sequence(raw: bytes) -> np.ndarray:
            # 32 bits may repeat within a text, rarely; the first stays
            seq = np.frombuffer(raw, "<u4")
            _, first = np.unique(seq, return_index=True)
            return seq if first.size == seq.size else seq[np.sort(first)]

        for batch in batches:
            for part in slices(batch):
                out = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if y != last[0]:
                        last = (y, sequence(y))
                    out.append(alignment(sequence(x), last[1], like))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["a", "b", "alike"])

    return map_batches(pairs, run, "a string, b string, alike double")


def _with_sequences(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    left = seqs.select(F.col("node").alias("a"), F.col("seq").alias("seq_a"))
    right = seqs.select(F.col("node").alias("b"), F.col("seq").alias("seq_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "seq_a", "seq_b")


def _distinct(raw: bytes) -> np.ndarray:
    """A text's different shingles, rising."""
    return np.unique(np.frombuffer(raw, "<u4"))


def _frequencies(texts: DataFrame) -> np.ndarray:
    """In how many rows of (node, seq) shingles of each of SLOTS slots (their low bits) occur.

    Tasks add up whole slices of the slots, so that no row is made for a shingle;
    what reaches the driver has the same size for any input.
    """

    def count(batches):
        sums = np.zeros(SLOTS, "<u4")
        for batch in batches:
            for part in slices(batch):
                for raw in part.column(1).to_pylist():
                    np.add.at(sums, _distinct(raw) & (SLOTS - 1), 1)
        for k, own in enumerate(sums.reshape(PARTS, -1)):
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], names=["part", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(raw), "<u4")
                sums[k] = sums[k] + own if k in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["part", "sums"])

    found = map_batches(map_batches(texts, count, "part int, sums binary").repartition(PARTS, "part"), add, "part int, sums binary")
    out = np.zeros((PARTS, SLOTS // PARTS), "<u4")
    for r in found.collect():
        out[r["part"]] += np.frombuffer(zlib.decompress(bytes(r["sums"])), "<u4")
    return out.reshape(-1)


def _prefixes(texts: DataFrame, often: np.ndarray, like: float) -> DataFrame:
    """node, n (its different shingles), common (how many texts have them, on average), and its rarest
    shingles with the room after each, for rows of (node, seq).

    Shingles are ordered by how many of these texts have their slot, then by value: an
    order that all texts share.  n - ceil(like * n) + 1 of a text's n are its prefix,
    and two texts alike by ``like`` have one of both prefixes in common.  Those in a
    slot of their own meet nothing and are left out.  Slots that several shingles share
    make this order less good and nothing wrong.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(4)]
                for raw in part.column(1).to_pylist():
                    own = _distinct(raw)
                    have = often[own & (SLOTS - 1)]
                    order = np.lexsort((own, have))[: own.size - math.ceil(own.size * like - 1e-9) + 1]
                    keep = np.flatnonzero(have[order] > 1)
                    for column, value in zip(out, (own.size, float(have.mean()) if own.size else 0.0, own[order[keep]].astype(np.int64), own.size - 1 - keep), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int64())), pa.array(out[3], pa.list_(pa.int64()))], names=["node", "n", "common", "tokens", "rooms"])

    return map_batches(texts, run, "node string, n bigint, common double, tokens array<bigint>, rooms array<bigint>")


def _rarely_met(prefixes: DataFrame, roots: DataFrame, like: float, scratch: Scratch) -> DataFrame:
    """(a, b) of different components that may be alike by ``like``, by prefix, length and position filters, all exact.

    What comes after the places of a shared shingle bounds the overlap, which must
    reach like / (1 + like) of both sizes together.

    A group of near copies shares hundreds of its shingles, nearly all of its nodes in
    one component by now.  So nodes do not meet nodes on shingles: a shingle keeps one
    row a component (how many have it, the bounds of their sizes and rooms), and only
    the nodes outside its largest component, the strays, meet these.  The components a
    stray has met are made distinct before they are opened to their members.
    """
    rare = prefixes.select("node", "n", F.explode(F.arrays_zip("tokens", "rooms")).alias("t")).select("node", "n", F.col("t.tokens").alias("token"), F.col("t.rooms").alias("room"))
    rare = scratch.keep(rare.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    by_root = rare.groupBy("token", "root").agg(F.count(F.lit(1)).alias("have"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.max("room").alias("room_b"))
    by_root = scratch.keep(by_root.withColumnRenamed("root", "rb"))
    tops = scratch.keep(by_root.groupBy("token").agg(F.max(F.struct("have", "rb")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("top.rb").alias("top")))
    strays = rare.join(tops, "token").where("root <> top").select("token", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("room").alias("room_a"), "top")
    strays = scratch.keep(strays)
    # the sizes of both must fit, and 1 + what follows the shingle in both must leave room for like / (1 + like) of them
    sizes = (F.col("n_hi") >= F.col("na") * like - 1e-6) & (F.col("n_lo") * like <= F.col("na") + 1e-6)
    room = 1 + F.least("room_a", "room_b") >= (F.col("na") + F.greatest("n_lo", F.ceil(F.col("na") * like - 1e-6))) * (like / (1 + like)) - 1e-6
    once = (F.col("rb") == F.col("top")) | (F.col("ra") < F.col("rb"))
    met = strays.join(by_root, "token").where((F.col("ra") != F.col("rb")) & once & sizes & room).select("a", "na", "rb").distinct()
    members = rare.select(F.col("root").alias("rb"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * like - 1e-6
    return scratch.keep(met).join(scratch.keep(members), "rb").where(fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame, like: float = LIKE, m: int = M, ell: int = ELL, k: int = K, scratch: Scratch | None = None) -> DataFrame:
    """One row a distinct text: digest, root (the class's least digest), doc_id (its least), n (its rows), class_id and class_rows.

    ``docs`` has doc_id and text.  Joins on a bucket, digest or component read written
    tables on both sides, so that adaptive execution can split a hot one.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    nodes = _sketched(rows, m, ell, k).groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch"))
    nodes = scratch.keep(nodes)
    members = nodes.where("sketch IS NOT NULL").select(F.col("digest").alias("node"), F.posexplode("sketch").alias("band", "value"))
    # each bucket's leader, by an order of its own
    shared = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", F.xxhash64("node", "band", "value")).alias("leader")).where("size > 1").drop("size")
    inside = scratch.keep(members.join(scratch.keep(shared), ["band", "value"]).select("band", "value", "node", "leader"))
    first = scratch.keep(inside.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())

    wanted = first.select("a").unionByName(first.select(F.col("b").alias("a"))).distinct()
    wanted = scratch.keep(nodes.join(wanted, nodes["digest"] == wanted["a"], "left_semi").select(F.col("digest").alias("node"), F.col("doc_id").alias("_id")))
    few = F.broadcast(wanted) if wanted.count() <= SMALL_IDS else wanted
    texts = rows.join(few, F.col("doc_id").eqNullSafe(F.col("_id"))).where(digest_of(F.col("text")) == F.col("node")).select("node", "text")
    seqs = scratch.keep(_shingled(texts, k).dropDuplicates(["node"]))
    scores = scratch.keep(_aligned(_with_sequences(first, seqs), like))
    links = scores.where(F.col("alike") >= like).select("a", "b")
    roots = scratch.keep(components(links, scratch))

    # Buckets whose nodes are not of one component have pairs that are still open.
    known = inside.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = known.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("band", "value", "size")
    toward = scores.select(F.col("a").alias("node"), F.col("b").alias("leader"), "alike")
    open_ = known.join(scratch.keep(mixed), ["band", "value"]).join(toward, ["node", "leader"], "left").select("band", "value", "size", "node", "root", F.coalesce("alike", F.lit(1.0)).alias("alike"))
    open_ = scratch.keep(open_)
    large = open_.where(F.col("size") > SMALL_BUCKET).select("band", "value", "node", "root")
    prefixes = None
    if large.take(1):
        texts = scratch.keep(large.select("node").distinct().join(seqs, "node").select("node", "seq"))
        prefixes = scratch.keep(_prefixes(texts, _frequencies(texts), like))
        # a second leader in each large bucket: the node with the most common shingles, which is alike with most of a group
        central = prefixes.select("node", "common")
        best = F.struct("common", "node")
        centers = scratch.keep(large.join(central, "node").groupBy("band", "value").agg(F.max_by("node", best).alias("b"), F.max_by("root", best).alias("root_b")))
        toward = scratch.keep(large.join(centers, ["band", "value"]).where("root <> root_b").select(F.col("node").alias("a"), "b").distinct())
        more = scratch.keep(_aligned(_with_sequences(toward, seqs), like).where(F.col("alike") >= like).select("a", "b"))
        roots = _merged(roots, more, scratch)
    small = open_.where(F.col("size") <= SMALL_BUCKET).drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    y = small.where(F.col("alike") < like).select("band", "value", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("alike").alias("alike_a"))
    x = small.select("band", "value", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("alike").alias("alike_b"))
    # 1 - likeness is a metric: alike(a, b) >= like needs the two distances to the leader to differ by at most 1 - like
    possible = (F.col("root_a") != F.col("root_b")) & F.when(F.col("alike_b") >= like, F.col("alike_b") - F.col("alike_a") <= 1 - like + 1e-9).otherwise(F.col("a") < F.col("b"))
    second = y.join(x, ["band", "value"]).where(possible).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if prefixes is not None:
        second = second.unionByName(_rarely_met(prefixes, roots, like, scratch))
    second = scratch.keep(second.distinct())
    late = scratch.keep(_aligned(_with_sequences(second, seqs), like).where(F.col("alike") >= like).select("a", "b"))
    roots = _merged(roots, late, scratch)

    out = nodes.drop("sketch").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    classes = out.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_rows"))
    return scratch.last(out.join(scratch.keep(classes), "root").select("digest", "root", "doc_id", "n", "class_id", "class_rows"))


def _merged(roots: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots`` with further links: components of components."""
    if not more.take(1):
        return roots
    return scratch.keep(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch))


def classify(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, class_rows (rows of its class) and copies (rows with its text) of each row."""
    texts = near_copies(docs, **how).select(F.col("digest").alias("_d"), "class_id", "class_rows", F.col("n").alias("copies"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text").cast("string")).alias("digest"))
    return rows.join(texts, F.col("digest") == F.col("_d")).select("doc_id", "class_id", "class_rows", "copies")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (all columns, of any names) with one row of each class: the one with the least doc_id."""
    scratch = Scratch(docs.sparkSession)
    digest, text_digest, least, stays = fresh(docs.columns, "digest", "text_digest", "least", "stays")
    texts = near_copies(docs, scratch=scratch, **how)
    # what goes: the texts that do not hold their class's least doc_id, and further rows of those that do
    held = texts.where("class_rows > 1").withColumn("rank", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest")))
    best = held.groupBy("root").agg(F.min("rank").alias("best"))
    held = held.join(scratch.keep(best), "root").select(F.col("digest").alias(digest), F.col("doc_id").alias(least), (F.col("rank") == F.col("best")).alias(stays))
    lost = scratch.keep(held)
    small = F.broadcast(lost) if lost.count() <= SMALL_IDS else lost
    marked = docs.withColumn(text_digest, digest_of(F.col("text").cast("string")))
    marked = marked.join(small, F.col(text_digest) == F.col(digest), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    alone = marked.where(F.col(digest).isNull()).select(*own)
    # rows that repeat the least doc_id with the same text are one
    first = marked.where(F.col(stays) & F.col("doc_id").eqNullSafe(F.col(least))).dropDuplicates([text_digest]).select(*own)
    return alone.unionByName(first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's class of near copies."""
    return classify(table(spark, sf_dir, "documents"))
