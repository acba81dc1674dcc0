"""Secret scans with structural confirmation.

Three plain patterns give the base findings (assign, access, hex).  The method
then decodes base64 and hex runs and reports what has the whole structure of a key:

* jwt: a signed token whose header parses as a JSON object that names an algorithm,
  with a JSON payload;
* der: a private key (PKCS #1, PKCS #8, encrypted PKCS #8 or SEC 1) whose nested
  lengths fill it; public keys and certificates are not reported;
* ssh: a key blob or private key file whose length-prefixed fields fill it;
* armour: text between BEGIN and END lines that decodes to one of these, to whole
  OpenPGP packets of a secret key, or to cipher blocks under a DEK-Info header.

A structure may begin anywhere inside a run (after "path/", say) and ends with it: a
run is decoded once for each of its four alignments, in which all places are then
looked at.  Patterns and checks are linear in the text.  Base findings always stay;
confirmed ones are added as spans of their own kinds.

Offsets are code points, ends exclusive.  Null texts are empty; an empty text
has no spans.  Texts are scanned whole; equal texts give equal results; other
columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.arrowmap import arrow_map, table

#: Fixed by the contract: kinds in order, patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_VALUE, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE = ("assign", "access", "hex")
#: A greedy run of the class, so that a least length drops just the short runs.
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
#: Kinds that the method adds.
ADDED = ("jwt", "der", "ssh", "armour")
RANK = {k: i for i, k in enumerate(BASE + ADDED)}

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{2,}+)\.[A-Za-z0-9_-]*")
#: Runs of the two base64 alphabets, and of hex.
RUNS = (re.compile(r"[A-Za-z0-9+/]{24,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{24,}={0,2}"))
HEX_RUN = re.compile(r"[0-9a-fA-F]{48,}")
MARKER = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
SSH_START = re.compile(rb"\0\0\0[\x07-\x30](?=ssh-|ecdsa-|sk-)|openssh-key-v1\0")
SSH_NAME = re.compile(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+")
DER_LEAST, SSH_LEAST = 32, 19
_JSON = json.JSONDecoder()


def unbase64(run: str) -> bytes | None:
    """Bytes of a base64 or base64url run, or None if it is neither."""
    body = run.rstrip("=")
    if len(body) % 4 == 1 or ("+" in body or "/" in body) and ("-" in body or "_" in body):
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def token_start(head: str, payload: str) -> int | None:
    """Where in ``head`` the header of a signed token begins: a JSON object up to its end that names
    an algorithm, if the payload is JSON; None if nowhere."""
    if "ey" not in head:
        return None
    found = None
    for skip in range(min(4, len(head))):
        # each alignment is decoded once; a wrong one hardly ever ends with a brace
        if (data := unbase64(head[skip:])) is None or data[-1:] != b"}":
            continue
        said = data.decode("latin-1")
        at = said.find("{")
        while at >= 0 and (found is None or skip + at // 3 * 4 < found):
            if at % 3 == 0:
                try:
                    fields, end = _JSON.raw_decode(said, at)
                except (ValueError, RecursionError):
                    fields, end = None, 0
                if end == len(said) and isinstance(fields, dict) and isinstance(fields.get("alg"), str):
                    found = skip + at // 3 * 4
                    break
            at = said.find("{", at + 1)
    if found is None:
        return None
    try:
        json.loads(unbase64(payload) or b"")
    except (ValueError, RecursionError):
        return None
    return found


def der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at ``at``, its length within ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def der_key(data: bytes, at: int = 0) -> bool:
    """One SEQUENCE from ``at`` that fills the bytes, whose nested items fill it, in the form of a private key."""
    top = der_item(data, at, len(data))
    if len(data) - at < DER_LEAST or top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    form, todo = "", [(top[1], top[2], True)]
    while todo:
        at, end, outer = todo.pop()
        while at < end:
            item = der_item(data, at, end)
            if item is None:
                return False
            tag, start, at = item
            if tag & 0x20:
                todo.append((start, at, False))
            if outer:
                form += {2: "i", 4: "o", 0x30: "s", 0xA0: "0", 0xA1: "1"}.get(tag, "?")
    # PKCS #8 (version, algorithm, key, attributes), encrypted PKCS #8, PKCS #1 (version and eight numbers), SEC 1
    return re.fullmatch(r"iso0?1?|so|iiiiiiiiis?|io0?1?", form) is not None


def _fields(data: bytes, at: int, end: int) -> list[bytes] | None:
    """Length-prefixed fields that fill the bytes, or None."""
    out = []
    while at < end:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > end or n > end - at - 4:
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def ssh_blob(data: bytes, at: int = 0) -> bool:
    """Length-prefixed fields that fill the bytes from ``at``, the first an algorithm name; or a whole private key file."""
    magic = b"openssh-key-v1\0"
    if data.startswith(magic, at):
        return _ssh_file(data[at + len(magic) :])
    fields = _fields(data, at, len(data))
    return len(data) - at >= SSH_LEAST and fields is not None and len(fields) >= 2 and SSH_NAME.fullmatch(fields[0]) is not None


def _ssh_file(data: bytes) -> bool:
    """Cipher, key derivation, its options, the number of keys, public keys, and the private ones, which fill the rest."""
    head, at = [], 0
    for _ in range(3):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        head.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    keys = int.from_bytes(data[at : at + 4], "big")
    fields = _fields(data, at + 4, len(data)) if at + 4 <= len(data) else None
    if not fields or not 1 <= keys == len(fields) - 1 or not all(ssh_blob(f) for f in fields[:-1]):
        return False
    secret = fields[-1]
    plain = head[0] == b"none"
    return re.fullmatch(rb"[a-z0-9@.-]+", head[0]) is not None and plain == (head[1] == b"none") and len(secret) >= 8 and len(secret) % 8 == 0 and (not plain or secret[:4] == secret[4:8])


def pgp_secret(data: bytes) -> bool:
    """OpenPGP packets that fill the bytes, the first a secret key."""
    at, tags = 0, []
    while at < len(data):
        b = data[at]
        at += 1
        if not b & 0x80:
            return False
        if b & 0x40:
            tags.append(b & 0x3F)
            n = data[at] if at < len(data) else 255
            if n < 192:
                at += 1
            elif n < 224:
                n, at = ((n - 192) << 8) + int.from_bytes(data[at + 1 : at + 2], "big") + 192, at + 2
            elif n == 255:
                n, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
            else:
                return False
        else:
            tags.append(b >> 2 & 0xF)
            if b & 3 == 3:
                return False
            size = 1 << (b & 3)
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        at += n
    return at == len(data) and tags[:1] == [5]


def key_start(data: bytes) -> tuple[int, str] | None:
    """(place, kind) of the first key that ends with the bytes and begins where a base64 group does."""
    at = data.find(b"\x30")
    best = None
    while at >= 0:
        if at % 3 == 0 and der_key(data, at):
            best = (at, "der")
            break
        at = data.find(b"\x30", at + 1)
    for m in SSH_START.finditer(data):
        if best is not None and m.start() > best[0]:
            break
        if m.start() % 3 == 0 and ssh_blob(data, m.start()):
            return m.start(), "ssh"
    return best


def run_span(run: str) -> tuple[int, str] | None:
    """(place, kind) of the first key in a base64 run."""
    found = []
    for skip in range(4):
        if (data := unbase64(run[skip:])) and (key := key_start(data)):
            found.append((skip + key[0] // 3 * 4, key[1]))
    return min(found, default=None)


def hex_span(run: str) -> tuple[int, str] | None:
    """The same for a hex run; a key may begin at any byte."""
    found = []
    for skip in range(2):
        if (len(run) - skip) % 2 == 0:
            data = bytes.fromhex(run[skip:])
            at = data.find(b"\x30")
            while at >= 0 and not der_key(data, at):
                at = data.find(b"\x30", at + 1)
            found += [(skip + 2 * at, "der")] if at >= 0 else []
            found += [(skip + 2 * m.start(), "ssh") for m in SSH_START.finditer(data) if ssh_blob(data, m.start())]
    return min(found, default=None)


def armoured(label: str, body: str) -> bool:
    """Whether what stands between the lines decodes to a whole key."""
    lines = [x.strip() for x in body.split("\n")]
    headers = [x for x in lines if ":" in x]
    data = unbase64("".join(x for x in lines if ":" not in x and x[:1] != "="))
    if not data or len(data) < DER_LEAST:
        return False
    if label.endswith("BLOCK"):
        return pgp_secret(data)
    if any(x.startswith("DEK-Info:") for x in headers):
        return len(data) % 8 == 0
    return der_key(data) or ssh_blob(data)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings, by start and kind."""
    out = []
    if any(w in (low := text.lower()) for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    del low
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]], s[1]))


def added_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decodes to key structures."""
    out = set()
    if "ey" in text:
        out |= {(m.start() + at, m.end(), "jwt") for m in TOKEN.finditer(text) if (at := token_start(m[1], m[2])) is not None}
    for pattern in RUNS:
        out |= {(m.start() + key[0], m.end(), key[1]) for m in pattern.finditer(text) if (key := run_span(m[0]))}
    out |= {(m.start() + key[0], m.end(), key[1]) for m in HEX_RUN.finditer(text) if (key := hex_span(m[0]))}
    if "-----BEGIN " in text:
        opened = None
        for m in MARKER.finditer(text):
            if m[1] == "BEGIN":
                opened = m
            elif opened is not None and opened[2] == m[2]:
                if armoured(m[2], text[opened.end() : m.start()]):
                    out.add((opened.start(), m.end(), "armour"))
                opened = None
    return sorted(out)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: counts of the base kinds, their digest, and all spans as text."""
    schema = {"doc_id": "long", "n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_confirmed": "long"}

    def make():
        def apply(keys, texts):
            out = [[] for _ in schema]
            for key, text in zip(keys, texts, strict=True):
                text = text or ""
                base, added = base_spans(text), added_spans(text)
                kinds = [s[2] for s in base]
                everything = sorted(base + added, key=lambda s: (s[0], RANK[s[2]], s[1]))
                row = (key, *map(kinds.count, BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(everything), len(added))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return apply

    return arrow_map(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's secrets."""
    return scan(table(spark, sf_dir, "documents"))
