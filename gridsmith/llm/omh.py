"""Order MinHash sketches of word k-mers.

A text becomes the sequence of its k-mers of words, each labelled with its
occurrence number (the first, second, ... time it appears), so that repeats
count.  For each of ``m`` hash functions the ``ell`` labelled k-mers with the
least hashes are taken and put back into text order; the hash of that tuple is
one sketch value.  Two texts share a value only if they share those k-mers *in
the same order*, which follows edit similarity, not just the sets.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

K = 5
BLOCK = 1 << 14
KEPT_WORDS = 200_000
_WORD = re.compile(r"\w+")
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the splitmix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Shingler:
    """Labelled k-mer hashes of texts; words' hashes are kept in a bounded cache."""

    def __init__(self, k: int = K):
        self.k = k
        self.kept: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        """64-bit hashes of the lower-cased words."""
        kept, digest = self.kept, xxhash.xxh3_64_intdigest
        found = _WORD.findall(text.lower())
        out = [kept.get(w) for w in found]
        if None in out:
            if len(kept) > KEPT_WORDS:
                kept.clear()
            for i, h in enumerate(out):
                if h is None:
                    w = found[i]
                    h = out[i] = digest(w)
                    kept[w] = h
        return np.array(out, dtype=_U)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Hashes of all runs of k words; all words together if there are fewer; none of no words."""
        n = words.size
        if not n:
            return words
        k = min(self.k, n)
        h = np.zeros(n - k + 1, _U)
        for j in range(k):
            h = h * _MULT + words[j : n - k + 1 + j]
        return mix(h)

    @staticmethod
    def labelled(shingles: np.ndarray) -> np.ndarray:
        """Shingle hashes made distinct by their occurrence number."""
        if shingles.size < 2:
            return mix(shingles)
        order = np.argsort(shingles, kind="stable")
        run = shingles[order]
        new = np.empty(run.size, bool)
        new[0] = True
        np.not_equal(run[1:], run[:-1], out=new[1:])
        if new.all():
            return mix(shingles)
        at = np.arange(run.size)
        occurrence = np.empty(run.size, _U)
        occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
        return mix(shingles + occurrence * _U(0xD6E8FEB86659FD93))

    def __call__(self, text: str) -> np.ndarray:
        return self.labelled(self.shingles(self.words(text)))


class Sketcher:
    """``m`` sketch values, each of ``ell`` ordered minima."""

    def __init__(self, m: int, ell: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.m, self.ell = m, ell
        self.xor = rng.integers(0, 2**64, m, dtype=_U)[:, None]
        self.mul = rng.integers(0, 2**64, m, dtype=_U)[:, None] | _U(1)

    def minima(self, labelled: np.ndarray) -> np.ndarray:
        """(m, up to ell): the places, in text order, of the least k-mers under each hash."""
        n, ell = labelled.size, self.ell
        if n <= ell:
            return np.broadcast_to(np.arange(n), (self.m, n))
        best = np.empty((self.m, 0), np.int64)
        best_v = np.empty((self.m, 0), _U)
        for at in range(0, n, BLOCK):
            v = (labelled[None, at : at + BLOCK] ^ self.xor) * self.mul
            places = np.broadcast_to(np.arange(at, at + v.shape[1]), v.shape)
            if best.shape[1]:
                v, places = np.concatenate([best_v, v], axis=1), np.concatenate([best, places], axis=1)
            if v.shape[1] > ell:
                pick = np.argpartition(v, ell - 1, axis=1)[:, :ell]
                v, places = np.take_along_axis(v, pick, axis=1), np.take_along_axis(places, pick, axis=1)
            best, best_v = places, v
        return np.sort(best, axis=1)

    def __call__(self, labelled: np.ndarray) -> np.ndarray:
        """The sketch; of no k-mers, all zeros."""
        if not labelled.size:
            return np.zeros(self.m, _U)
        chosen = labelled[self.minima(labelled)]
        h = np.zeros(self.m, _U)
        for j in range(chosen.shape[1]):
            h = h * _MULT + chosen[:, j]
        return mix(h ^ self.xor[:, 0])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal sketch values."""
    return float(np.count_nonzero(a == b)) / max(1, a.size)
