"""SentencePiece BPE encoding and decoding by exact backtracking.

Encoding does not run the merge queue over the text.  A piece sequence is the
merge result exactly if every two neighbours are compatible, that is if merging
their joined text gives the same two pieces back.  So the encoder walks the
text, takes the longest piece at each place (found for all places in one
Aho-Corasick pass), goes on to its shorter prefixes when the neighbour check
fails, and steps back when none is left; a bitfield of failed places makes sure
that no place is tried twice, which keeps it linear.

Pieces hold the space mark only as a leading run, so a text is cut before each
run of marks and at characters without a piece, and each cut part is encoded
alone with the same result.  Encoded parts are kept in a bounded cache.

Nulls are taken as empty texts; an empty text has no ids and decodes to "".
Repeated rows give repeated rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_PARTS = 300_000
KEPT_FITS = 300_000
CACHED_CHARS = 64


def _fields(buf: bytes):
    """(field number, value) of one protocol buffer message; nested ones stay bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = out = 0
        while True:
            b = buf[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, buf[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, buf[at : at + n]
            at += n


class PieceModel:
    """A BPE model file of the sentencepiece format, without the library."""

    def __init__(self, model: bytes):
        import struct

        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        flags = {"prefix": 1, "squeeze": 1, "escape": 1, "bytes": 0, "model": 1, "suffix": 0}
        for field, value in _fields(model):
            if field == 1:
                m = dict(_fields(value))
                self.pieces.append(m[1].decode())
                scores.append(struct.unpack("<f", m[2])[0] if 2 in m else 0.0)
                self.kinds.append(m.get(3, NORMAL))
            elif field == 2:
                m = dict(_fields(value))
                flags |= {"model": m.get(3, 1), "suffix": m.get(24, 0), "bytes": m.get(35, 0)}
            elif field == 3:
                m = dict(_fields(value))
                flags |= {"prefix": m.get(3, 1), "squeeze": m.get(4, 1), "escape": m.get(5, 1)}
                if m.get(2):
                    raise ValueError("a model with a character map is not supported")
        if flags["model"] != 2 or flags["squeeze"] or not flags["escape"] or flags["suffix"]:
            raise ValueError("only BPE models with the identity normaliser are supported")
        if any(k in (USER, UNUSED) for k in self.kinds):
            raise ValueError("user-defined or unused pieces are not supported")
        self.prefix, self.byte_fallback = bool(flags["prefix"]), bool(flags["bytes"])
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.unk = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.shown = [p.replace(MARK, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.special = frozenset(i for i, k in enumerate(self.kinds) if k != NORMAL)
        self.longest = max(map(len, self.ids))
        self.cuttable = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.find_parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.alphabet = frozenset(p for p in self.ids if len(p) == 1)
        known = "".join(map(re.escape, sorted(self.alphabet)))
        self.find_known = re.compile(f"([{known}]+)|([^{known}])").findall
        #: Pieces that merging can make; the others never occur in a result.
        self.good = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        #: The size of each piece's longest proper prefix that is a piece too; 0 if there is none.
        self.shorter = [0] * len(self.pieces)
        for p, i in self.good.items():
            self.shorter[i] = next((k for k in range(len(p) - 1, 0, -1) if p[:k] in self.good), 0)
        self.decimals = [str(i) for i in range(len(self.pieces))]
        self.machine = ahocorasick.Automaton()
        for p in self.good:
            self.machine.add_word(p, len(p))
        self.machine.make_automaton()
        self.fits: dict[int, bool] = {}
        # encoded parts; the old half goes when the young half is full
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: best rank first, leftmost among equals.  For short texts only."""
        syms = list(text)
        rank = self.rank
        while len(syms) > 1:
            best, at = None, -1
            for i in range(len(syms) - 1):
                r = rank.get(syms[i] + syms[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            syms[at : at + 2] = [syms[at] + syms[at + 1]]
        return syms

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the joined text gives the two pieces back."""
        if len(self.fits) > KEPT_FITS:
            self.fits.clear()
        a, b = self.pieces[left], self.pieces[right]
        ok = self.fits[left << 24 | right] = self.merged(a + b) == [a, b]
        return ok

    def _backtrack(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are pieces."""
        n = len(text)
        at_most = [1] * n  # the longest piece that begins at each place
        for end, size in self.machine.iter(text):
            if size > at_most[end - size + 1]:
                at_most[end - size + 1] = size
        get_fit, good, shorter = self.fits.get, self.good, self.shorter
        closed = bytearray(n + 1)  # the bitfield, a byte a place: set if the place does not lead to the end
        out: list[int] = []
        ends = [0]
        last = -1
        pos, size = 0, at_most[0]
        while pos < n:
            while size:
                end = pos + size
                piece = good[text[pos:end]]
                if not closed[end] and (last < 0 or ((ok := get_fit(last << 24 | piece)) or (ok is None and self._fit(last, piece)))):
                    break
                size = shorter[piece]
            if size:
                out.append(piece)
                ends.append(end)
                last = piece
                pos = end
                if pos < n:
                    size = at_most[pos]
            else:
                # step back: this place is closed, and the last piece's next shorter one is tried
                if last < 0:
                    raise RuntimeError("no piece sequence")
                closed[pos] = 1
                ends.pop()
                pos = ends[-1]
                size = shorter[out.pop()]
                last = out[-1] if out else -1
        return out

    def _new_part(self, part: str) -> tuple[int, ...]:
        """Ids of one part; characters without a piece become bytes or the unknown id."""
        if self.alphabet.issuperset(part):
            made = tuple(self._backtrack(part))
        else:
            got: list[int] = []
            for known, other in self.find_known(part):
                if known:
                    got += self._backtrack(known)
                else:
                    got += [self.byte_ids[b] for b in other.encode()] if self.byte_fallback else [self.unk]
            made = tuple(got)
        if len(part) <= CACHED_CHARS:
            if len(self.young) >= CACHE_PARTS // 2:
                self.old, self.young = self.young, {}
            self.young[part] = made
        return made

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return self.find_parts(text) if self.cuttable else [text]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        young, old = self.young.get, self.old.get
        for part in self._cut(text):
            if (got := young(part)) is None and (got := old(part)) is None:
                got = self._new_part(part)
                young, old = self.young.get, self.old.get
            ids += got
        return ids

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same in decimal joined by commas."""
        ids = self.encode(text)
        return ids, ",".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The library's text for ids: bytes joined to characters, invalid ones
        replaced, one leading space dropped if the model adds one."""
        shown, special = self.shown, self.special
        if special.isdisjoint(ids):
            text = "".join([shown[i] for i in ids])
            return text[1:] if self.prefix and text[:1] == " " else text
        out, run, first = [], bytearray(), self.prefix
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                first = False
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if self.kinds[i] == CONTROL:
                continue
            s = shown[i]
            out.append(s[1:] if first and self.kinds[i] == NORMAL and s[:1] == " " else s)
            first = False
        if run:
            out.append(_lenient(bytes(run)))
        return "".join(out)


def _lenient(run: bytes) -> str:
    """UTF-8 with one replacement character for each byte that fits no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_LOADED: dict[bytes, PieceModel] = {}


def loaded(model: bytes) -> PieceModel:
    """The model, built once in a worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = PieceModel(model)
    return _LOADED[key]


def default_model() -> bytes:
    """The bytes of the public 32k piece model; they travel with the job, so executors open no file."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again; one row for each row of ``df``.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256; ``with_ids`` adds the
    ids and the decoded text.
    """
    model = default_model() if model is None else model
    schema = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        schema |= {"ids": "array<long>", "decoded": "string"}

    def make():
        m = loaded(model)
        sha = hashlib.sha256

        def apply(keys, texts):
            n, a, b, every, back = [], [], [], [], []
            for t in texts:
                ids, said = m.encode_with_text(t or "")
                text = m.decode(ids)
                n.append(len(ids))
                a.append(sha(said.encode()).hexdigest())
                b.append(sha(text.encode()).hexdigest())
                if with_ids:
                    every.append(ids)
                    back.append(text)
            return (keys, n, a, b, every, back)[: len(schema)]

        return apply

    return arrow_map(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's token count and the digests of its ids and decoded text."""
    return encode_decode(table(spark, sf_dir, "documents"))
