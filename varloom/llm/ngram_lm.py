"""LM scoring: an interpolated modified Kneser-Ney trigram model over sorted hash arrays.

Counting: each task sums its n-grams into sorted arrays, cuts them by key range and sends one
block per range; a range's task merges its blocks and writes them to the shared folder as one
sorted array. Keys are one-to-one mixes of word ids, so ranges are even and a hot n-gram is
one entry of each block. A trigram goes to the range of its first two words, so the counts of
what follows a pair are local to a range; only the pairs that trigrams end with are sent on.

A sorted array is stored as a directory over the leading bits of its keys, the next bits of
each key, and a code for its values, as few n-grams differ in their counts. Scoring maps these
files into memory and finds a batch's n-grams in them, so a worker holds no table of its own.
"""

from __future__ import annotations

import functools
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import shared_dir, table, written
from varloom.llm.tokens import U, mix, slices, summed, with_ends

#: Bytes of training text for one key range, and n-grams that a task sums before it sends them.
RANGE_BYTES, FLUSH = 8 << 20, 2_000_000
#: Keys of a directory's cell, on average, and bits of an n-gram's key behind the directory's that are stored: pairs of up
#: to 2^27 words are told apart exactly, and an n-gram that is not there is taken for another one in 500 million look-ups.
#: Words are stored with whole keys, so which words training saw, and how often, is exact.
CELL, REST = 8, 32
#: Context of the first token of a text.
START = (1 << 32) - 1
LOW = U(START)


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path that workers can map; it must be mounted (file:// or plain)."""
    path = shared_dir(spark)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"the model is memory-mapped, so spark.checkpoint.dir must be a mounted folder, not {path}")
    return path


class Pairs:
    """A one-to-one map of pairs of ids under 2^bits to keys whose leading bits are even, and back.

    Keys use 2 * bits leading bits only, so that sorted ones differ by little and pack well.
    """

    def __init__(self, ids: int):
        self.bits = max(int(ids).bit_length(), 1)
        self.mask = U((1 << self.bits) - 1)

    def turn(self, x: np.ndarray, k: int) -> np.ndarray:
        return mix(x + U(k + 1) * U(0x9E3779B97F4A7C15)) & self.mask

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.where(a == LOW, self.mask, a), np.where(b == LOW, self.mask, b)
        for k in range(4):
            a, b = b, a ^ self.turn(b, k)
        return ((a << U(self.bits)) | b) << U(64 - 2 * self.bits)

    def second(self, keys: np.ndarray) -> np.ndarray:
        """The second id of each pair."""
        keys = keys >> U(64 - 2 * self.bits)
        a, b = keys >> U(self.bits), keys & self.mask
        for k in reversed(range(4)):
            a, b = b ^ self.turn(a, k), a
        return b

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The first id of each pair; START where the text starts."""
        keys = keys >> U(64 - 2 * self.bits)
        a, b = keys >> U(self.bits), keys & self.mask
        for k in reversed(range(4)):
            a, b = b ^ self.turn(a, k), a
        return np.where(a == self.mask, LOW, a)


def triple(pair: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of a pair's key and the word after it."""
    return mix(mix(pair) ^ mix(word + U(0x5851F42D4C957F2D)))


@functools.lru_cache(maxsize=1)
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(a: np.ndarray) -> bytes:
    """The numbers with their first bytes together, then their second ones and so on, packed by frequency: few-valued bytes take few bits."""
    return codec()[0].compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()) if len(a) else b""


def from_planes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(codec()[1].decompress(data) if data else b"", np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def packed(a: np.ndarray) -> bytes:
    """Numbers from 0 as planes of the narrowest kind that holds them all, after its size."""
    size = next(x for x in (1, 2, 4, 8) if x == 8 or not len(a) or int(a.max()) < 1 << (8 * x))
    return bytes([size]) + planes(np.ascontiguousarray(a, dtype=f"<u{size}"))


def unpacked(data: bytes) -> np.ndarray:
    return from_planes(data[1:], f"<u{data[0]}").astype("<u8")


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the differences to the one before."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return planes(out)


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, "<u8"), dtype=U)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many even ranges of the 64-bit keys; a key's place inside its range is within()."""
    return ((keys >> U(32)) * U(ranges) + ((keys & LOW) * U(ranges) >> U(32))) >> U(32)


def within(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Keys of one range, spread over all 64 bits in the same order."""
    return keys * U(ranges)


def pieces_of(keys: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    """(range, its part) of sorted keys, for the ranges that have any."""
    own = range_of(keys, ranges).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
    for i, j in zip(new, [*new[1:], len(own)]):
        yield int(own[i]), slice(i, j)


def save(folder: str, r: int, name: str, data: np.ndarray) -> None:
    """Writes a file first under another name: a task that runs twice leaves whole files."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{r:08d}.{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, np.ascontiguousarray(data))
    os.replace(part, f"{folder}/{r:08d}.{name}.npy")


@functools.lru_cache(maxsize=8192)
def mapped(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r")


def coded(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(code of each row of values, distinct rows): codes are as narrow as their number allows."""
    h = np.zeros(len(values[0]), dtype=U)
    for v in values:
        h = mix(h ^ v.astype(U) + U(0x9E3779B97F4A7C15))
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    narrow = np.uint8 if len(first) <= 1 << 8 else np.uint16 if len(first) <= 1 << 16 else np.uint32
    return code.astype(narrow), np.stack([v[first].astype(np.int64) for v in values], axis=1)


def write_array(folder: str, r: int, keys: np.ndarray, values: list[np.ndarray], whole: bool = False) -> None:
    """Sorted distinct keys, spread over 64 bits, with their values; whole ones if so asked. A range without keys has an empty directory only."""
    if not len(keys):
        return save(folder, r, "at", np.zeros(3, np.uint32))
    bits = max((len(keys) // CELL).bit_length(), 1)
    at = np.searchsorted(keys >> U(64 - bits), np.arange((1 << bits) + 1, dtype=U))
    save(folder, r, "at", at.astype(np.uint32 if len(keys) < 1 << 32 else np.uint64))
    if whole:
        save(folder, r, "keys", keys)
    else:
        rest = keys << U(bits) >> U(64 - REST)
        save(folder, r, "rest", rest.astype(np.uint32))
    write_values(folder, r, values)


def write_values(folder: str, r: int, values: list[np.ndarray], kind: str = "") -> None:
    code, rows = coded(values)
    save(folder, r, f"{kind}code", code)
    save(folder, r, f"{kind}rows", rows)


def find(folder: str, r: int, keys: np.ndarray, kind: str = "", whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(place in the range or -1, value rows or zeros) of keys of a range. Every range has a directory, so a file that is lost or not yet seen raises."""
    path = f"{folder}/{r:08d}"
    at = mapped(f"{path}.at.npy")
    if not at[-1]:
        return np.full(len(keys), -1, np.int64), np.zeros((len(keys), 1), np.int64)
    code, rows = (mapped(f"{path}.{x}.npy") for x in (f"{kind}code", f"{kind}rows"))
    bits = (len(at) - 1).bit_length() - 1
    cell = (keys >> U(64 - bits)).astype(np.int64)
    if whole:
        stored, wanted = mapped(f"{path}.keys.npy"), keys
    else:
        stored, wanted = mapped(f"{path}.rest.npy"), (keys << U(bits) >> U(64 - REST)).astype(np.uint32)
    place, end = at[cell].astype(np.int64), at[cell + 1].astype(np.int64)
    out = np.full(len(keys), -1, np.int64)
    live = np.flatnonzero(place < end)
    while len(live):
        hit = stored[place[live]] == wanted[live]
        out[live[hit]] = place[live[hit]]
        live = live[~hit]
        place[live] += 1
        live = live[place[live] < end[live]]
    values = np.zeros((len(keys), rows.shape[1]), np.int64)
    values[out >= 0] = rows[code[out[out >= 0]]]
    return out, values


def look_up(folder: str, ranges: int, by: np.ndarray, keys: np.ndarray, width: int, kind: str = "", whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(range, place in it or -1, values or zeros) of keys, each in the range of its `by`."""
    own = range_of(by, ranges).astype(np.int64)
    order = np.argsort(own, kind="stable")
    place, values = np.full(len(keys), -1, np.int64), np.zeros((len(keys), width), np.int64)
    new = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]])) if len(own) else []
    for i, j in zip(new, [*new[1:], len(own)]):
        at = order[i:j]
        k, back = np.unique(keys[at], return_inverse=True)
        p, v = find(folder, int(own[at[0]]), k, kind, whole)
        place[at] = p[back]
        if v.shape[1] == width:
            values[at] = v[back]
    return own, place, values


def merged(rows: DataFrame, ranges: int, work: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs work(range, its rows) for each key range, dealt to so many partitions that few hold more than one."""

    def each(key, frame):
        return work(key[0].as_py(), frame)

    return rows.repartition(4 * max(ranges, 1), "range").groupBy("range").applyInArrow(each, schema)


def every_range(rows: DataFrame, ranges: int) -> DataFrame:
    """rows and one without keys for each range, so that each range's task runs and leaves its directory."""
    blank = {"range": "CAST(id AS int)", "kind": "0", "c": "X'01'"}
    return rows.unionAll(rows.sparkSession.range(ranges).selectExpr(*[blank.get(c, "X''") for c in rows.columns]))


def arrays(frame: pa.Table, column: str, read: Callable[[bytes], np.ndarray], empty: str = "<u8") -> np.ndarray:
    return np.concatenate([read(x.as_py()) for x in frame.column(column)] or [np.zeros(0, empty)])


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.9, 2.9))]


def how_many(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def following(c: np.ndarray, new: np.ndarray) -> list[np.ndarray]:
    """Per group of n-grams with one context: their total, and how many have count 1, 2 and more."""
    return [np.add.reduceat(x.astype(np.int64), new) for x in (c, c == 1, c == 2, c >= 3)]


def taken(d: list[float], c: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def gamma(d: list[float], n: np.ndarray) -> np.ndarray:
    """What the discounts leave to shorter contexts; 1 where a context was never seen. n: total, and numbers with count 1, 2 and more."""
    total = np.maximum(n[:, 0], 1)
    return np.where(n[:, 0] > 0, (d[0] * n[:, 1] + d[1] * n[:, 2] + d[2] * n[:, 3]) / total, 1.0)


class Model:
    """What scoring needs beside the files: folder, ranges, discounts and counts of the whole."""

    def __init__(self, folder: str, ranges: int, tokens: int, vocabulary: int):
        self.folder, self.ranges, self.tokens, self.vocabulary = folder, ranges, tokens, vocabulary
        self.pairs = Pairs(vocabulary + 1)
        self.d1 = self.d2 = self.d3 = [0.5, 1.0, 1.5]
        # without training: the end of a text or an unseen word, one as likely as the other
        self.kinds, self.unseen, self.start = 0, 0.5, [0, 0, 0, 0]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of known words, -1 for others."""
        own, place, _ = look_up(f"{self.folder}/word", self.ranges, hashes, within(hashes, self.ranges), 1, whole=True)
        return np.where(place >= 0, place + mapped(f"{self.folder}/base.npy")[own], -1)

    def log10(self, hashes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, training count) of every token of the texts."""
        first = np.zeros(len(hashes), dtype=bool)
        first[np.cumsum(tokens) - tokens] = True
        own, place, word = look_up(f"{self.folder}/word", self.ranges, hashes, within(hashes, self.ranges), 6, "all", whole=True)
        known = place >= 0
        ids = np.where(known, place + mapped(f"{self.folder}/base.npy")[own], 0).astype(U)
        count, follows, after = word[:, 0], word[:, 1], word[:, 2:]
        # one token: continuation counts, all unseen words being one more word
        p = (follows - taken(self.d1, follows)) / max(self.kinds, 1) + self.unseen / (self.vocabulary + 1)
        # two tokens
        before = np.roll(ids, 1)
        before[first] = LOW
        context = np.roll(after, 1, axis=0)
        context[first] = self.start
        both = known & (first | np.roll(known, 1))
        at = np.flatnonzero(both)
        keys = np.zeros(len(ids), dtype=U)
        keys[at] = self.pairs.keys(before[at], ids[at])
        pair = np.zeros((len(ids), 5), np.int64)
        _, _, pair[at] = look_up(f"{self.folder}/pair", self.ranges, keys[at], within(keys[at], self.ranges), 5)
        c = pair[:, 0]
        p = (c - taken(self.d2, c)) / np.maximum(context[:, 0], 1) + gamma(self.d2, context) * p
        # three tokens, from the second of a text on
        context = np.roll(pair[:, 1:], 1, axis=0)
        context[first] = 0
        c = np.zeros(len(ids), np.int64)
        at = np.flatnonzero((context[:, 0] > 0) & known)
        _, _, got = look_up(f"{self.folder}/triple", self.ranges, keys[at - 1], triple(keys[at - 1], ids[at]), 1)
        c[at] = got[:, 0]
        p = (c - taken(self.d3, c)) / np.maximum(context[:, 0], 1) + gamma(self.d3, context) * p
        return np.log10(p), count


def fit(texts: DataFrame, text: str = "text", range_bytes: int = RANGE_BYTES) -> Model:
    """Counts the texts of a table and writes the model to the shared folder.

    Null and empty texts have one token, their end. Repeated rows count each time. An empty
    table gives a model without words: every token has probability one half.
    Counts are 64-bit. The driver gets one row per key range.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{text}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = max(1, -(-size // range_bytes))
    folder = f"{shared_path(spark)}/lm-{uuid.uuid4().hex}"

    # words: range, place in it and count
    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, c = summed(np.concatenate(held))
            c = c.astype("<u8")
            own = list(pieces_of(keys, ranges))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in own], pa.int32()), pa.array([steps(keys[s]) for _, s in own], pa.binary()), pa.array([packed(c[s]) for _, s in own], pa.binary())], ["range", "keys", "c"])

        held, n = [], 0
        for batch in batches:
            for _, _, h, t in slices(batch.column(0)):
                held.append(with_ends(h, t)[0])
                n += len(held[-1])
                if n >= FLUSH:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def merge_words(r: int, frame: pa.Table) -> pa.Table:
        keys, c = summed(arrays(frame, "keys", from_steps), arrays(frame, "c", unpacked))
        write_array(f"{folder}/word", r, within(keys, ranges), [c], whole=True)
        return pa.table({"range": pa.array([r], pa.int32()), "n": [len(keys)], "tokens": [int(c.sum())]})

    got = merged(every_range(rows.mapInArrow(count_words, "range int, keys binary, c binary"), ranges), ranges, merge_words, "range int, n long, tokens long").collect()
    sizes = np.zeros(ranges + 1, np.int64)
    for r in got:
        sizes[r["range"] + 1] = r["n"]
    base = np.cumsum(sizes)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/base.npy", "wb") as f:
        np.save(f, base)
    model = Model(folder, ranges, sum(r["tokens"] for r in got), int(base[-1]))
    if model.vocabulary >= START - 1:
        raise ValueError("more distinct words than ids")
    if not model.tokens:
        return model
    pairs = model.pairs

    # trigrams, in the range of their first two words, and the pairs that texts start with
    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(keys: list[np.ndarray], words: list[np.ndarray], starts: list[np.ndarray]) -> pa.RecordBatch:
            k, w = np.concatenate(keys), np.concatenate(words).astype("<u4")
            order = np.lexsort((w, k))
            k, w = k[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])) if len(k) else np.zeros(0, np.int64)
            c = np.diff(np.append(new, len(k))).astype("<u8")
            k, w = k[new], w[new]
            s, sc = summed(np.concatenate(starts))
            sc = sc.astype("<u8")
            out = [(r, 0, steps(k[x]), planes(w[x]), packed(c[x])) for r, x in pieces_of(k, ranges)]
            out += [(r, 1, steps(s[x]), b"", packed(sc[x])) for r, x in pieces_of(s, ranges)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["range", "kind", "keys", "w", "c"])

        keys, words, starts, n = [], [], [], 0
        for batch in batches:
            for _, _, h, t in slices(batch.column(0)):
                h, t = with_ends(h, t)
                ids = model.ids(h).astype(U)
                first = np.zeros(len(h), dtype=bool)
                first[np.cumsum(t) - t] = True
                before = np.roll(ids, 1)
                before[first] = LOW
                own = pairs.keys(before, ids)
                later = np.flatnonzero(~first)
                keys.append(own[later - 1])
                words.append(ids[later])
                starts.append(own[first])
                n += len(ids)
                if n >= FLUSH:
                    yield block(keys, words, starts)
                    keys, words, starts, n = [], [], [], 0
        if n:
            yield block(keys, words, starts)

    sent = "range int, kind int, keys binary, v0 binary, v1 binary, v2 binary, v3 binary, own int, many array<long>"
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int32(), pa.list_(pa.int64()))
    names = ["range", "kind", "keys", "v0", "v1", "v2", "v3", "own", "many"]

    def message(rows: list[tuple]) -> pa.Table:
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    def merge_triples(r: int, frame: pa.Table) -> pa.Table:
        kind = frame.column("kind").to_numpy()
        tri, start = frame.filter(pa.array(kind == 0)), frame.filter(pa.array(kind == 1))
        k, w, c = arrays(tri, "keys", from_steps), arrays(tri, "w", lambda b: from_planes(b, "<u4"), "<u4"), arrays(tri, "c", unpacked)
        out: list[tuple] = []
        many = [0] * 4
        if not len(k):
            write_array(f"{folder}/triple", r, k, [])
        else:
            order = np.lexsort((w, k))
            k, w, c = k[order], w[order], c[order]
            new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])]))
            c = np.add.reduceat(c, new)
            k, w = k[new], w[new]
            del order, new
            t = triple(k, w.astype(U))
            order = np.argsort(t)
            write_array(f"{folder}/triple", r, t[order], [c[order]])
            del t, order
            many = how_many(c)
            new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            out.append((r, 2, steps(k[new]), *[packed(v) for v in following(c, new)], r, None))
            # the pairs that these trigrams end with: each has another first word
            s, n = summed(pairs.keys(pairs.second(k), w.astype(U)))
            n = n.astype("<u8")
            out += [(q, 3, steps(s[x]), packed(n[x]), b"", b"", b"", r, None) for q, x in pieces_of(s, ranges)]
        if start.num_rows:
            s, n = summed(arrays(start, "keys", from_steps), arrays(start, "c", unpacked))
            out.append((r, 3, steps(s), packed(n), b"", b"", b"", r, None))
        out.append((r, 4, b"", b"", b"", b"", b"", r, many))
        return message(out)

    def merge_pairs(r: int, frame: pa.Table) -> pa.Table:
        kind = frame.column("kind").to_numpy()
        ends, contexts, told = (frame.filter(pa.array(kind == x)) for x in (3, 2, 4))
        k, c = summed(arrays(ends, "keys", from_steps), arrays(ends, "v0", unpacked))
        values = [c.astype(np.int64), *[np.zeros(len(k), np.int64) for _ in range(4)]]
        if contexts.num_rows:
            at = np.searchsorted(k, arrays(contexts, "keys", from_steps))
            for v, name in zip(values[1:], ("v0", "v1", "v2", "v3")):
                v[at] = arrays(contexts, name, unpacked)
        write_array(f"{folder}/pair", r, within(k, ranges), values)
        out: list[tuple] = []
        if len(k):
            a, b = pairs.first(k), pairs.second(k)
            order = np.argsort(a, kind="stable")
            ids, n = a[order], values[0][order]
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            out += to_words(2, ids[new], following(n, new))
            ids, n = summed(b)
            out += to_words(3, ids, [n])
        many = np.sum([x for x in told.column("many").to_pylist()] or [[0] * 4], axis=0).tolist()
        out.append((-1, 4, b"", b"", b"", b"", b"", len(k), [*many, *how_many(values[0])]))
        return message(out)

    def to_words(kind: int, ids: np.ndarray, values: list[np.ndarray]) -> list[tuple]:
        """Messages to the ranges of words; START's go to a range of its own."""
        own = np.searchsorted(base, ids.astype(np.int64), side="right") - 1
        own[ids == LOW] = ranges
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        data = [ids, *values]
        return [(int(own[i]), kind, steps(data[0][i:j]), *[packed(v[i:j]) for v in data[1:]], *[b""] * (5 - len(data)), 0, None) for i, j in zip(new, [*new[1:], len(ids)])]

    def merge_contexts(r: int, frame: pa.Table) -> pa.Table:
        kind = frame.column("kind").to_numpy()
        told, contexts, ends = (frame.filter(pa.array(kind == x)) for x in (4, 2, 3))
        n = 0 if r < 0 or r == ranges else int(sizes[r + 1])
        values = [np.zeros(max(n, 1), np.int64) for _ in range(6)]
        first = START if r == ranges else int(base[max(r, 0)])
        if contexts.num_rows:
            ids, *v = summed(arrays(contexts, "keys", from_steps), *[arrays(contexts, x, unpacked) for x in ("v0", "v1", "v2", "v3")])
            for x, y in zip(values[2:], v):
                x[ids.astype(np.int64) - first] = y
        if ends.num_rows:
            ids, v = summed(arrays(ends, "keys", from_steps), arrays(ends, "v0", unpacked))
            values[1][ids.astype(np.int64) - first] = v
        if n:
            code, rows = (np.load(f"{folder}/word/{r:08d}.{x}.npy") for x in ("code", "rows"))
            values[0] = rows[code, 0]
            write_values(f"{folder}/word", r, values, "all")
        many = np.sum([x for x in told.column("many").to_pylist()] or [[0] * 8], axis=0).tolist()
        f = values[1]
        return pa.table({"range": pa.array([r], pa.int32()), "pairs": [int(told.column("own").to_numpy().sum())], "many": pa.array([[*many, *how_many(f), int((f >= 3).sum())]], pa.list_(pa.int64())), "start": pa.array([[int(v[0]) for v in values[2:]]], pa.list_(pa.int64()))})

    triples = merged(every_range(rows.mapInArrow(count_triples, "range int, kind int, keys binary, w binary, c binary"), ranges), ranges, merge_triples, sent)
    done = merged(merged(triples, ranges, merge_pairs, sent), ranges, merge_contexts, "range int, pairs long, many array<long>, start array<long>").collect()
    many = np.sum([r["many"] for r in done], axis=0)
    model.kinds = sum(r["pairs"] for r in done)
    model.start = next((list(r["start"]) for r in done if r["range"] == ranges), [0] * 4)
    model.d3, model.d2, model.d1 = (discounts([int(x) for x in many[k : k + 4]]) for k in (0, 4, 8))
    n1, n2, n3 = int(many[8]), int(many[9]), int(many[12])
    model.unseen = (model.d1[0] * n1 + model.d1[1] * n2 + model.d1[2] * n3) / max(model.kinds, 1)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns with n_tokens, n_known, base_score and score (sums of log10 over the tokens) of every row.

    Null and empty texts have one token, their end; repeated rows are scored alike. A kept
    column that has the name of a result gives way.
    """
    results = ["n_tokens", "n_known", "base_score", "score"]
    keep = tuple(c for c in keep if c not in results)
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("__t"))
    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema[:-1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, h, n in slices(batch.column(len(names)), 2 << 20):
                h, n = with_ends(h, n)
                p, c = model.log10(h, n)
                at = np.cumsum(n) - n
                base = np.log10((c + 1.0) / (model.tokens + model.vocabulary + 1))
                parts.append((n, np.add.reduceat((c > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(p, at)))
            cols = [np.concatenate(x) for x in zip(*parts)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]], [*names, *results])

    out = rows.mapInArrow(work, f"{own}n_tokens long, n_known long, base_score double, score double")
    return out.withColumnsRenamed(dict(zip(names, keep)))


def scored_once(docs: DataFrame, model: Model, **named) -> DataFrame:
    """scored() as a table; the model's files are deleted then."""
    try:
        return written(scored(docs, model, **named), "scores")
    finally:
        shutil.rmtree(model.folder, ignore_errors=True)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")))
    out = scored_once(docs, model, keep=("doc_id", "held_out"))
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
