"""Vectorised text kernels shared by the training-data operators.

Everything here works on the raw UTF-8 buffers of Arrow string columns, block by block, so that one
batch never needs more than a few dozen megabytes of temporaries whatever the length of its texts.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D; as those bytes never occur inside a
multi-byte sequence this is exactly ``[^\\x20\\x09-\\x0D]+`` on the text.  The hash of a byte string
is ``sum(table[b_j] * BASE**j) mod 2**64`` over its bytes; with running sums it costs a few machine
operations a byte, and dividing by ``BASE**start`` makes it independent of where the string stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit bijection that spreads every input bit (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed << 20)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TABLE = random_words(256, 1)
TABLE2 = random_words(256, 2)
#: One odd multiplier for each place in a run of words, and one addend for each length of a short run.
PLACE = random_words(64, 3) | U64(1)
LENGTH = random_words(64, 4)


class _Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 4096)
            for name, step in (("up", BASE), ("down", INVERSE)):
                powers = np.full(size, step, dtype=U64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_powers = _Powers()


def running(data: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """``r[j]`` is the hash sum of the first j bytes."""
    up, _ = _powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end)."""
    _, down = _powers.get(len(sums))
    return (sums[end] - sums[start]) * down[start]


def _long_hash(span: np.ndarray, table: np.ndarray) -> int:
    """The hash of one span of any length, piece by piece."""
    total = 0
    for at in range(0, len(span), BLOCK):
        total += int(running(span[at : at + BLOCK], table)[-1]) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def span_hasher(data: np.ndarray, table: np.ndarray = TABLE) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function for the hashes of spans [start, end) with ascending starts and ends.  Of long data only a piece is worked on at a time."""
    if len(data) <= 4 * BLOCK:
        sums = running(data, table)
        return lambda start, end: spans_hash(sums, start, end)

    def pieces(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out, lo = np.zeros(len(start), dtype=U64), 0
        while lo < len(start):
            if end[lo] - start[lo] > BLOCK:
                out[lo] = _long_hash(data[start[lo] : end[lo]], table)
                lo += 1
                continue
            hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, side="right")))
            a, b = start[lo], end[hi - 1]
            out[lo:hi] = spans_hash(running(data[a:b], table), start[lo:hi] - a, end[lo:hi] - a)
            lo = hi
        return out

    return pieces


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string_view(column.type) or not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same form, of a list of byte strings."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), off


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word never runs from one row into the next."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~SPACE[data]
    change = solid[1:] != solid[:-1]
    starts, ends = np.flatnonzero(change & solid[1:]), np.flatnonzero(change & solid[:-1])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut)
    cut = cut[solid[cut] & solid[cut + 1]] if len(cut) else cut  # solid is shifted by one: bytes cut-1 and cut
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, starts, ends, ptr): row d has the words ptr[d]..ptr[d+1].  Long rows are hashed piecewise."""
    starts, ends = word_spans(data, off)
    ptr = np.searchsorted(starts, off)
    ptr[-1] = len(starts)
    return span_hasher(LOWER[data] if lower else data)(starts, ends), starts, ends, ptr


def runs(word: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place on; the last n-1 places are not meaningful."""
    size = len(word) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    out = word[:size] * PLACE[0]
    for j in range(1, n):
        out += word[j : j + size] * PLACE[j]
    out += LENGTH[(n + salt) % 64]
    return mix64(out)


def shingles(word: np.ndarray, ptr: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the hashes of its n-word shingles in order; a row of fewer words has one, one without words none."""
    every = runs(word, n)
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= n:
            yield every[a : b - n + 1]
        elif b > a:
            yield runs(word[a:b], b - a, salt=0)
        else:
            yield every[:0]


def shingle_sets(column: pa.Array, n: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, ascending."""
    data, off = utf8(column)
    for lo, hi in blocks(off):
        hashes, _, _, ptr = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
        for s in shingles(hashes, ptr, n):
            yield np.unique(s)
