"""Words of Arrow text columns as arrays of 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed at a time; a longer text is hashed in pieces that end between words.
SLICE = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
# A-Z hash as a-z
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
STEP = U(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, dtype=U)]
#: The end of a text, counted as a token.
END = U(0x5851F42D4C957F2D)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one map of 64-bit values that spreads them evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = (x ^ (x >> U(31)) ^ (x >> U(62))) * U(0x319642B2D24D8EC3)
    x = (x ^ (x >> U(27)) ^ (x >> U(54))) * U(0x96DE1B173F119089)
    return x ^ (x >> U(30)) ^ (x >> U(60))


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 256), STEP, dtype=U)]), dtype=U)
    return _POWERS[0]


def words_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of texts data[starts[i]:stops[i]], which adjoin."""
    if not len(data):
        return np.zeros(0, dtype=U), np.zeros(len(starts), dtype=np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = starts < stops  # a text's edges end words too
    first[starts[full]] = word[starts[full]]
    last[stops[full] - 1] = word[stops[full] - 1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, dtype=U), np.zeros(len(starts), dtype=np.int64)
    size = np.flatnonzero(last) + 1 - at
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) - np.repeat(ends - size, size)
    hashes = np.add.reduceat(BYTE[data[word]] * powers(int(size.max()))[place], ends - size)
    return mix(hashes ^ size.astype(U)), np.searchsorted(at, stops) - np.searchsorted(at, starts)


def pieces_of_text(raw: np.ndarray, lo: int, hi: int, most: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of about `most` bytes that no word crosses; a longer word is a part of its own."""
    while lo < hi:
        end = min(hi, lo + most)
        if end < hi:
            gaps = np.flatnonzero(SPACE[raw[lo:end]])
            if len(gaps):
                end = lo + int(gaps[-1]) + 1
            while not len(gaps) and end < hi:
                gaps = np.flatnonzero(SPACE[raw[end : min(hi, end + most)]])
                end = end + int(gaps[0]) + 1 if len(gaps) else min(hi, end + most)
        yield lo, end
        lo = end


def words_of_long(raw: np.ndarray, lo: int, hi: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [words_of(raw[a:b], np.array([0]), np.array([b - a]))[0] for a, b in pieces_of_text(raw, lo, hi, most)]
    hashes = np.concatenate(parts)
    return hashes, np.array([len(hashes)])


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words of each row) over a text column; null is as empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        lo = at[row]
        if at[end] - lo > most:
            yield row, end, *words_of_long(raw, int(lo), int(at[end]), most)
            row = end
            continue
        yield row, end, *words_of(raw[lo : at[end]], at[row:end] - lo, at[row + 1 : end + 1] - lo)
        row = end


def with_ends(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with an END after each text's; tokens of each text."""
    stop = np.cumsum(counts + 1)
    out = np.empty(len(hashes) + len(counts), dtype=U)
    ends = np.zeros(len(out), dtype=bool)
    ends[stop - 1] = True
    out[ends], out[~ends] = END, hashes
    return out, counts + 1


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their values; without values, their counts."""
    if not len(keys):
        return (keys, *[v[:0] for v in values]) if values else (keys, np.zeros(0, np.int64))
    if not values:
        keys = np.sort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[new], np.diff(np.append(new, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[new], *[np.add.reduceat(v[order], new) for v in values])
