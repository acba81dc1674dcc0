"""URL filter: host rules, then gradient-boosted trees on lexical features.

Rules (verdict, host, path) fit a host and its subdomains if the path starts with
the rule's; the longest fitting rule decides.  Other urls are judged by boosted
regression trees over lexical features: length, host length, depth, digit ratio,
entropy of the host, parameter counts and suffix statistics.  The trees are grown on
the driver from labelled urls (at most MAX_LABELLED rows, taken in hash order) whose
features are computed by the same SQL expressions, and become nested CASE
expressions, so judging is one projection: no join, no shuffle, no Python.  (The
entropy is a higher-order function, which Spark evaluates outside generated code.)

No table labels urls.  The labelled ones (``labelled_urls``) are random urls of
invented words, labelled by a rule that weighs several signs: length, depth, share of
digits, entropy, parameters and suffix.  No single sign decides.

Null urls and urls without "://" have an empty host and path and are judged like
any other text.  Repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import table

#: Fixed by the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

MAX_LABELLED = 20_000
ROUNDS, DEPTH, RATE, LEAST_LEAF, L2 = 60, 3, 0.3, 2.0, 1.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Last labels of hosts whose share of blocked urls is a feature.
SUFFIX_SMOOTHING = 4.0

# Labelled urls: random parts, and a rule over several signs.
LABELLED, SEED = 1600, 5
_SUFFIXES = (("com", 0.0), ("org", -0.6), ("net", 0.0), ("edu", -1.2), ("info", 0.5), ("biz", 0.9), ("top", 1.2), ("click", 1.4))


def labelled_urls(n: int = LABELLED, seed: int = SEED) -> list[tuple[str, int]]:
    """(url, 1 to block and 0 to allow) of ``n`` random urls."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(k))
    noise = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        risky = rng.random()  # how likely each part is to be of the worse kind
        worse = lambda: rng.random() < risky * 0.7  # noqa: E731, B023
        host = noise(rng.randint(8, 24)) if worse() else word(rng.randint(2, 4)) + (rng.choice(("", "-", "")) + word(rng.randint(1, 3)) if rng.random() < 0.5 else "")
        front = rng.choice(("", "", "www.", "m.", "blog."))
        suffix, odds = rng.choice(_SUFFIXES[4:] if worse() else _SUFFIXES[:5])
        middle = rng.choice(("", ".example"))
        parts = [noise(rng.randint(4, 16)) if worse() else rng.choice((word(rng.randint(1, 4)), "en", "fr", str(rng.randint(1, 9999)), str(rng.randint(1990, 2030)))) for _ in range(rng.randint(4, 9) if worse() else rng.randint(0, 4))]
        params = [f"{word(1)}={noise(rng.randint(4, 20)) if worse() else word(2)}" for _ in range(rng.randint(3, 9) if worse() else rng.choice((0, 0, 0, 1, 1, 2)))]
        path = "/" + "/".join(parts) + rng.choice(("", "/", ".html")) if parts else rng.choice(("", "/"))
        name = front + host + middle + "." + suffix
        url = f"{rng.choice(('http', 'https'))}://{name}{path}" + ("?" + "&".join(params) if params else "") + rng.choice(("", "", "#top"))
        counts = Counter(name)
        entropy = -sum(c / len(name) * math.log2(c / len(name)) for c in counts.values())
        digits = sum(c.isdigit() for c in url) / len(url)
        signs = (len(url) - 55) / 40 + (len(parts) - 3.5) / 2.5 + (digits - 0.12) / 0.08 + (entropy - 3.45) / 0.35 + (len(params) - 2) / 2 + odds
        out.append((url, int(signs > 1.2)))
    return out


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest fitting rule as text, its verdict); null where none fits."""
    rule = verdict = None
    for say, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = (F if rule is None else rule).when(fits, F.lit(h + p))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(say))
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need no labels."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n_host = F.length(host)
    letters = F.array_distinct(F.split(host, ""))
    share = lambda c: (n_host - F.length(F.replace(host, c, F.lit("")))) / F.greatest(n_host, F.lit(1))
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    digits = lambda c: F.length(c) - F.length(F.translate(c, "0123456789", ""))
    return {
        "length": F.length(url).cast("double"),
        "host_length": n_host.cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "digit_ratio": (digits(url) / F.greatest(F.length(url), F.lit(1))).cast("double"),
        "entropy": F.when(n_host > 0, entropy).otherwise(0.0).cast("double"),
        "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


class Model:
    """Boosted trees over named features, with the suffixes' log odds as one of them."""

    def __init__(self, names: list[str], base: float, trees: list, suffixes: dict[str, float]):
        self.names, self.base, self.trees, self.suffixes = names, base, trees, suffixes

    def margin(self, features: dict[str, Column]) -> Column:
        """The log odds of blocking, as one expression."""

        def grown(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, low, high = node
            return F.when(features[self.names[at]] <= cut, grown(low)).otherwise(grown(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + grown(tree)
        return total

    def score(self, row: list[float]) -> float:
        """The same for one row of values, for tests."""
        total = self.base
        for node in self.trees:
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total


def grow(rows: list[list[float]], labels: list[int], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Second-order boosting of the logistic loss with exact splits: (base margin, trees)."""
    x, y = np.array(rows, float).reshape(len(rows), len(rows[0]) if rows else 0), np.array(labels, float)
    n = y.size
    p = (y.sum() + 1) / (n + 2)
    base = math.log(p / (1 - p))
    margin, trees = np.full(n, base), []

    def node(at: np.ndarray, left: int):
        g, h = float(grad[at].sum()), float(hess[at].sum())
        split = best_split(x[at], grad[at], hess[at]) if left else None
        if split is None:
            value = rate * g / (h + L2)
            margin[at] += value
            return value
        _, j, cut = split
        low = x[at, j] <= cut
        return j, cut, node(at[low], left - 1), node(at[~low], left - 1)

    for _ in range(rounds if n else 0):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-9)
        trees.append(node(np.arange(n), depth))
    return base, trees


def best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, feature, cut) of the best split of some rows, the first of equal ones; None if none gains."""
    g, h = grad.sum(), hess.sum()
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gl, hl = x[order, j], np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        may = (v[:-1] < v[1:]) & (hl >= LEAST_LEAF) & (h - hl >= LEAST_LEAF)
        if not may.any():
            continue
        gain = np.where(may, gl**2 / (hl + L2) + (g - gl) ** 2 / (h - hl + L2) - g * g / (h + L2), -np.inf)
        i = int(gain.argmax())
        if gain[i] > (best[0] if best else 1e-6):
            best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    return best


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """A model from (url, label) rows; at most ``max_rows`` of them, in hash order, reach the driver."""
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    got = rows.select(suffix_of(F.col("host")).alias("suffix"), "label", F.array(*features.values()).alias("x")).collect()
    seen: dict[str, list[int]] = {}
    for r in got:
        seen.setdefault(r["suffix"], []).append(r["label"])
    every = (sum(r["label"] for r in got) + 0.5) / (len(got) + 1)
    odds = {}
    for s, ys in seen.items():
        p = (sum(ys) + SUFFIX_SMOOTHING * every) / (len(ys) + SUFFIX_SMOOTHING)
        odds[s] = math.log(p / (1 - p))
    base, trees = grow([[*r["x"], odds[r["suffix"]]] for r in got], [r["label"] for r in got])
    return Model([*features, "suffix"], base, trees, odds)


def seed_frame(spark: SparkSession) -> DataFrame:
    """``labelled_urls`` as rows, from one literal."""
    rows = json.dumps([{"url": u, "label": y} for u, y in labelled_urls()])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<url:string,label:int>>")))


def judge(df: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and margin (the method's log odds of blocking) of each row."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    suffix = suffix_of(F.col("host"))
    odds = F.lit(0.0)
    for s, v in sorted(model.suffixes.items()):
        odds = F.when(suffix == s, F.lit(v)).otherwise(odds)
    features = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix": odds}
    # named columns, so that each feature is computed once and the trees only compare
    rows = rows.withColumns({f"_{k}": c for k, c in features.items()})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    margin = model.margin({k: F.col(f"_{k}") for k in features})
    rows = rows.withColumn("_margin", margin)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("_margin") > 0, "block").otherwise("allow")).alias("verdict"), F.col("_margin").alias("margin"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the verdict on every page's url."""
    return judge(table(spark, sf_dir, "pages"), train(seed_frame(spark)))
