"""Toxic spans and document scores by a linear-chain conditional random field.

Words are a chain of two states, clean and toxic.  Emissions are sums of learned
weights of a word's features (the word, its beginnings and endings); transitions
are learned too.  Forward-backward marginals give each word's probability of
being toxic; the sum and maximum of the marked ones, through a logistic calibration, give the
document's score, and words above SPAN_LEVEL give the offending offsets.

Labels are of documents, so the words' training labels come from them: a word of
a toxic training document is labelled toxic if one of its features is tied to
toxic documents (a likelihood ratio beyond what the number of features tried of
its kind would give by chance) and hardly ever occurs in clean ones.  Only rows with crc32(doc_id) mod 5 <> 0 are learned from, at most
MAX_TOXIC and MAX_CLEAN documents (the least by a hash of doc_id), which are
fitted on the driver; a third of them fits only the calibration.

Scoring is one pass over the texts, without a shuffle.  Chains are solved in
blocks: 2 x 2 products within blocks for all documents at once, then along the
blocks, so a very long document costs as much a word as a short one.

Null and empty texts have no words and get the calibration's score for that.
Null doc_ids are never held out or learned from.  Without toxic or without clean
labels every score is 0.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, map_batches, slices, table

MAX_TOXIC, MAX_CLEAN = 600, 1800
LINK, LEAST_RATIO = 8.0, 20.0
ROUNDS, RATE, L2 = 40, 0.5, 0.05
FIT_DOCS = 800
BLOCK = 64
SPAN_LEVEL = 0.5
COUNTED = 0.2
HOLD_FOLD, FOLDS = 0, 5
KEPT_WORDS = 200_000
WORD = re.compile(r"\w+")
BEGINNINGS, ENDINGS = (3, 4, 5, 6, 7), (4, 5)


def features(word: str) -> list[str]:
    """The word, and its beginnings and endings of some lengths."""
    n = len(word)
    return ["=" + word, *["^" + word[:k] for k in BEGINNINGS if k < n], *["$" + word[-k:] for k in ENDINGS if k < n]]


class Chain:
    """Two-state chains: emission log odds a word, and a 2 x 2 matrix of transition potentials."""

    def __init__(self, transitions: np.ndarray, first: float):
        self.t = np.exp(np.asarray(transitions, float))
        self.first = math.exp(first)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """P(toxic) of each word of the documents one after another; with ``pairs``, also
        the expected number of transitions of each kind."""
        lengths = np.asarray(lengths)
        n_blocks = -(-lengths // BLOCK)
        total = int(n_blocks.sum())
        if not total:
            return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
        starts = np.concatenate([[0], np.cumsum(n_blocks)[:-1]])
        doc_of = np.repeat(np.arange(lengths.size), lengths)
        within = np.arange(doc_of.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        slot = starts[doc_of] * BLOCK + within
        odds = np.ones(total * BLOCK)
        odds[slot] = np.exp(np.clip(emissions, -40, 40))
        real = np.zeros(total * BLOCK, bool)
        real[slot] = True
        odds, real = odds.reshape(total, BLOCK), real.reshape(total, BLOCK)
        t = self.t
        # ahead[b, k]: how (a0, a1) before block b becomes that after its word k; back: the same from the end
        ahead = np.empty((BLOCK, 2, 2, total))
        m = np.stack([np.stack([np.ones(total), np.zeros(total)]), np.stack([np.zeros(total), np.ones(total)])])
        for k in range(BLOCK):
            e, r = odds[:, k], real[:, k]
            a = t[0, 0] * m[0] + t[1, 0] * m[1]
            b = (t[0, 1] * m[0] + t[1, 1] * m[1]) * e
            norm = a.sum(0) + b.sum(0)
            m = np.where(r, np.stack([a, b]) / norm, m)
            ahead[k] = m
        entry = np.empty((2, total))
        order = np.argsort(-n_blocks, kind="stable")
        state = np.stack([np.full(lengths.size, 1.0), np.full(lengths.size, self.first)])
        whole = ahead[-1]
        for j in range(int(n_blocks.max())):
            live = order[: int(np.searchsorted(-n_blocks[order], -j, side="left"))]
            at = starts[live] + j
            entry[:, at] = state[:, live]
            s = np.einsum("ijb,jb->ib", whole[:, :, at], state[:, live])
            state[:, live] = s / s.sum(0)
        fwd = np.einsum("kijb,jb->kib", ahead, entry)
        back = np.empty((BLOCK, 2, 2, total))
        m = np.stack([np.stack([np.ones(total), np.zeros(total)]), np.stack([np.zeros(total), np.ones(total)])])
        for k in range(BLOCK - 1, -1, -1):
            back[k] = m  # from after the block to after word k
            e, r = odds[:, k], real[:, k]
            lo, hi = m[0], m[1] * e
            a, b = t[0, 0] * lo + t[0, 1] * hi, t[1, 0] * lo + t[1, 1] * hi
            norm = a.sum(0) + b.sum(0)
            m = np.where(r, np.stack([a, b]) / norm, m)
        leave = np.empty((2, total))
        state = np.ones((2, lengths.size))
        for j in range(int(n_blocks.max()) - 1, -1, -1):
            live = order[: int(np.searchsorted(-n_blocks[order], -j, side="left"))]
            at = starts[live] + j
            leave[:, at] = state[:, live]
            s = np.einsum("ijb,jb->ib", m[:, :, at], state[:, live])
            state[:, live] = s / s.sum(0)
        beta = np.einsum("kijb,jb->kib", back, leave)
        both = fwd * beta
        p = (both[:, 1] / both.sum(1)).T.reshape(-1)[slot]
        if not pairs:
            return p
        # xi(t) is in proportion to alpha(t - 1) T e(t) beta(t); the first word's predecessor is the start
        f = fwd.transpose(2, 0, 1).reshape(-1, 2)[slot]
        b = beta.transpose(2, 0, 1).reshape(-1, 2)[slot]
        before = np.vstack([[[1.0, self.first]], f[:-1]])
        before[within == 0] = (1.0, self.first)
        e = odds.reshape(-1)[slot]
        xi = before[:, :, None] * t[None] * np.stack([np.ones_like(e), e], 1)[:, None, :] * b[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        return p, xi.sum(0), float(xi[within == 0][:, 1, :].sum())


class Model:
    """Feature weights, chain and calibration."""

    def __init__(self, weights: dict[str, float], bias: float, chain: Chain, calibration: np.ndarray):
        self.weights, self.bias, self.chain, self.calibration = weights, bias, chain, calibration
        self.kept: dict[str, float] = {}

    def emissions(self, words: list[str]) -> list[float]:
        kept = self.kept
        out = [kept.get(w) for w in words]
        if None in out:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            get, bias = self.weights.get, self.bias
            for i, v in enumerate(out):
                if v is None:
                    out[i] = kept[words[i]] = bias + sum([get(f, 0.0) for f in features(words[i])])
        return out

    def __getstate__(self):
        return self.__dict__ | {"kept": {}}

    def score(self, texts: list[str]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """Each text's score and its toxic spans (start, end) in code points."""
        values, lengths = [], []
        for t in texts:
            e = self.emissions(WORD.findall(t.lower()))
            values.extend(e)
            lengths.append(len(e))
        p = self.chain.marginals(np.array(values), np.array(lengths, dtype=np.int64))
        ends = np.cumsum(lengths)
        hot = np.flatnonzero(p >= SPAN_LEVEL)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        sums = gathered(p, lengths)
        for i in sorted(set(np.searchsorted(ends, hot, side="right").tolist())):
            own = set((hot[(hot < ends[i]) & (hot >= ends[i] - lengths[i])] - (ends[i] - lengths[i])).tolist())
            lowered = texts[i].lower()
            # lower-casing may lengthen a text, and then offsets are of its folded form's words, found again in the text
            found = WORD.finditer(lowered if len(lowered) == len(texts[i]) else texts[i])
            spans[i] = [m.span() for k, m in enumerate(found) if k in own]
        return logistic(sums @ self.calibration[:-1] + self.calibration[-1]).tolist(), spans


def gathered(p: np.ndarray, lengths: list[int]) -> np.ndarray:
    """What the calibration sees of each document: the log of its summed marginals, and their maximum.

    Marginals below COUNTED are left out of the sum, so that a very long document
    does not become toxic by many words that are hardly suspect."""
    p = np.where(p >= COUNTED, p, 0.0)
    lengths = np.asarray(lengths, dtype=np.int64)
    total, most = np.zeros(lengths.size), np.zeros(lengths.size)
    full = np.flatnonzero(lengths)
    if full.size:
        at = (np.cumsum(lengths) - lengths)[full]
        total[full], most[full] = np.add.reduceat(p, at), np.maximum.reduceat(p, at)
    return np.stack([np.log(total + 0.02), most], 1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def linked(toxic: Counter, clean: Counter, n1: int, n0: int) -> set[str]:
    """Features tied to toxic documents.  The bar for each kind of feature (its first
    letter and length) rises with the number of that kind that were tried."""
    kind = lambda f: (f[0], len(f) if f[0] != "=" else 0)
    tried = Counter(kind(f) for f, k in toxic.items() if k >= 3)
    out = set()
    for f, k1 in toxic.items():
        k0 = clean.get(f, 0)
        if k1 < 3 or (k1 / n1) < LEAST_RATIO * ((k0 + 0.25) / n0):
            continue
        p, p1, p0 = (k1 + k0) / (n1 + n0), k1 / n1, k0 / n0
        like = lambda k, n, q: (k * math.log(q) if k else 0.0) + ((n - k) * math.log(1 - q) if n > k else 0.0)
        ratio = 2 * (like(k1, n1, p1) + like(k0, n0, p0) - like(k1, n1, p) - like(k0, n0, p))
        if ratio >= LINK + 2 * math.log(tried[kind(f)]):
            out.add(f)
    return out


def _counted(docs: list[np.ndarray], names: list[str], only: Counter | None = None) -> Counter:
    """In how many documents each feature occurs; with ``only``, of those features alone."""
    out: Counter = Counter()
    for ids in docs:
        fs = {f for i in set(ids.tolist()) for f in features(names[i])}
        out.update(fs if only is None else fs & only.keys())
    return out


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """The field from two thirds of the documents, the calibration from the rest."""
    if not any(labels) or all(labels):
        return Model({}, -20.0, Chain(np.zeros((2, 2)), 0.0), np.array([0.0, 0.0, -40.0]))
    part = np.array([zlib.crc32(t.encode()) % 3 for t in texts])
    truth = np.array(labels)
    for y in (0, 1):  # both parts need both labels
        own = np.flatnonzero(truth == y)
        if len(set((part[own] == 0).tolist())) < 2:
            part[own] = (np.arange(own.size) + 1) % 3
    learn = np.flatnonzero(part)
    rest = np.flatnonzero(part == 0) if {*truth[part == 0].tolist()} == {0, 1} else learn
    ids: dict[str, int] = {}
    docs = [np.array([ids.setdefault(w, len(ids)) for w in WORD.findall(texts[i].lower())], dtype=np.int64) for i in learn]
    names = list(ids)
    y_doc = truth[learn]
    toxic = _counted([d for d, y in zip(docs, y_doc, strict=True) if y], names)
    # emissions are needed only for features that some toxic documents share
    toxic = Counter({f: k for f, k in toxic.items() if k >= 2})
    clean = _counted([d for d, y in zip(docs, y_doc, strict=True) if not y], names, toxic)
    tied = linked(toxic, clean, int(y_doc.sum()), int((1 - y_doc).sum()))
    index = {f: j for j, f in enumerate(sorted(toxic))}
    rows, columns = [], []
    hot = np.zeros(len(names), bool)
    for r, w in enumerate(names):
        fs = features(w)
        hot[r] = not tied.isdisjoint(fs)
        own_ = [index[f] for f in fs if f in index]
        columns.extend(own_)
        rows.extend([r] * len(own_))
    rows, columns = np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)
    tags = [hot[d] & bool(y) for d, y in zip(docs, y_doc, strict=True)]
    seen_pairs = np.zeros((2, 2))
    y_count = np.zeros(len(names))
    for d, t in zip(docs, tags, strict=True):
        np.add.at(seen_pairs, (np.concatenate([[0], t[:-1]]).astype(int)[: t.size], t.astype(int)), 1)
        np.add.at(y_count, d[t], 1)
    w, bias, trans, first = np.zeros(len(index)), -4.0, np.zeros((2, 2)), -6.0
    g_w, g_b, g_t = np.full(len(index), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    size = sum(d.size for d in docs)
    groups = [docs[i : i + FIT_DOCS] for i in range(0, len(docs), FIT_DOCS)]
    for _ in range(rounds):
        e = np.bincount(rows, w[columns], minlength=len(names)) + bias
        chain, by_word, pairs = Chain(trans, first), y_count.copy(), np.zeros((2, 2))
        for g in groups:
            stream = np.concatenate(g)
            if stream.size:
                p, got, _ = chain.marginals(e[stream], np.array([d.size for d in g]), pairs=True)
                by_word -= np.bincount(stream, p, minlength=len(names))
                pairs += got
        d_w = np.bincount(columns, by_word[rows], minlength=len(index)) - L2 * w
        d_b = float(by_word.sum())
        d_t = seen_pairs - pairs - L2 * trans * size / 1000
        g_w += d_w**2
        g_b += d_b**2
        g_t += d_t**2
        w += RATE * d_w / np.sqrt(g_w)
        bias += RATE * d_b / math.sqrt(g_b)
        trans += RATE * d_t / np.sqrt(g_t)
    model = Model({f: float(w[j]) for f, j in index.items() if abs(w[j]) > 1e-3}, float(bias), Chain(trans, first), np.zeros(3))
    x = []
    for i in range(0, rest.size, FIT_DOCS):
        values = [model.emissions(WORD.findall(texts[j].lower())) for j in rest[i : i + FIT_DOCS]]
        n = [len(v) for v in values]
        x.append(gathered(model.chain.marginals(np.array([v for vs in values for v in vs]), np.array(n)), n))
    x = np.column_stack([np.concatenate(x), np.ones(rest.size)])
    t = truth[rest].astype(float)
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps with a ridge
        q = logistic(x @ beta)
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        beta += np.linalg.solve(h, x.T @ (t - q) - 0.05 * beta)
    model.calibration = beta
    model.kept = {}
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model from the labelled training documents: at most ``max_toxic`` and ``max_clean`` reach the driver."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HOLD_FOLD).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.xxhash64("doc_id")
    chosen = own.where("toxic = 1").orderBy(place, "doc_id").limit(max_toxic).unionByName(own.where("toxic = 0").orderBy(place, "doc_id").limit(max_clean)).collect()
    if not chosen:
        return fit([], [])
    # bounded by the two limits, so it can be broadcast
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "_id bigint, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    # a doc_id that is repeated gives one document, by the least digest of its texts
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))), "text", "toxic")).alias("m"))
    got = sorted((r["doc_id"], r["m"]["text"] or "", r["m"]["toxic"]) for r in texts.collect())
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans ("start:end" joined by commas) of each row."""
    kinds = {"doc_id": "long", "held_out": "boolean", "score": "double", "predicted": "int", "spans": "string"}

    def make():
        def apply(keys, texts):
            scores, spans = model.score([t or "" for t in texts])
            held = [k is not None and zlib.crc32(str(k).encode()) % FOLDS == HOLD_FOLD for k in keys]
            return keys, held, scores, [int(s >= 0.5) for s in scores], [",".join(f"{a}:{b}" for a, b in s) for s in spans]

        return apply

    return arrow_map(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), kinds, make)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not judged toxic, with all their columns."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in slices(batch):
                scores, _ = model.score([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return map_batches(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's toxicity."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
