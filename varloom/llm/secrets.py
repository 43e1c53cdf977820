"""Secret scans: keyword automaton, anchored patterns near its hits, then checksums inside the match."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from varloom.llm.common import table

#: Kinds in the order of the listing.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "card")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----")
CARD = re.compile(rb"(?<![0-9])[3-6][0-9]{12,18}(?![0-9])")

#: Lower-case keyword -> kind. The automaton reads the text once, in lower case.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "pem"}
NEAR = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def base62_crc(body: bytes) -> bytes:
    """The six base-62 digits of the CRC-32 that such tokens end with."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.encode()


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, m: re.Match) -> bool:
    """What the match itself can prove: its length, or the checksum in it."""
    s = m.group()
    if kind == "assign":
        return len(m.group(2)) >= 6
    if kind == "access":
        return len(s) >= 20
    if kind in ("github", "npm"):
        return base62_crc(s[4:-6]) == s[-6:]
    if kind == "card":
        return luhn(s)
    return True


def scan(a: ahocorasick.Automaton, data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every finding in UTF-8 text, by start and kind, in code points."""
    found = []
    after = dict.fromkeys(NEAR, 0)
    # bytes as Latin-1 characters keep their places; lower() on bytes touches A-Z only
    for end, (length, kind) in a.iter(data.lower().decode("latin-1")):
        start = end - length + 1
        if start >= after[kind] and (m := NEAR[kind].match(data, start)):
            after[kind] = m.end()
            if valid(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    for kind, pattern in (("hex", HEX), ("card", CARD)):
        found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(data) if valid(kind, m)]
    if found and not data.isascii():
        at = sorted({x for s, _, e in found for x in (s, e)})
        points, n, last = {}, 0, 0
        for x in at:
            n, last = n + len(data[last:x].decode("utf-8", "replace")), x
            points[x] = n
        found = [(points[s], k, points[e]) for s, k, e in found]
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def findings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every row; null and empty texts have none.

    A key hit counts once per kind, leftmost first, without overlaps inside a kind. Repeated
    rows give repeated results. A text is read as one run of bytes, whatever its length.
    """
    rows = docs.select(key, text)
    kind = rows.schema[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            out = []
            for t in batch.column(1).cast(pa.binary()):
                found = scan(a, t.as_py() or b"")
                base = [x for x in found if x[1] < 3]
                out.append((*[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(work, f"id {kind.dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string").withColumnRenamed("id", key)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
