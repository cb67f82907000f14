"""Vectorised scanning of UTF-8 text held in Arrow buffers.

All positions are byte offsets into one contiguous numpy buffer that holds
several whole documents; nothing here ever cuts a document.  Words are hashed
eight bytes at a time, each step through a bijective mixer, so equal hashes of
unequal words are a matter of chance.  Hashes of runs of words (or of bytes) are
prefix sums of a polynomial over Z/2^64, so the hash of any run is a difference
of two prefix sums times an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASES = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B)
_INVERSES = tuple(pow(b, -1, 2**64) for b in BASES)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table over bytes: True where a byte separates words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Everything in ASCII but digits and lower-case letters.
SYMBOLS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Start values and factors of two independent word hashes.
WORD_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
WORD_FACTORS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, U64(base))
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def prefix(codes: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of codes[i] * base**i, with a leading zero."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(BASES[which], len(codes)), out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Place-independent hash of each run [start, end) of what was summed."""
    return mix((sums[end] - sums[start]) * powers(_INVERSES[which], len(sums))[start])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of documents of about ``limit`` bytes; a longer one stands alone."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Words:
    """The words of several whole documents.

    ``start``/``end``: byte spans; ``first``: for each document the index of
    its first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = False):
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = data[low:high]
        if lower:
            self.data = LOWER[self.data]
        self.offsets = offsets - low
        gap = table[self.data]
        opens, closes = np.empty(len(gap), bool), np.empty(len(gap), bool)
        if len(gap):
            opens[0], opens[1:] = True, gap[:-1]
            closes[-1], closes[:-1] = True, gap[1:]
            inner = self.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < len(gap))]
            opens[inner] = True
            closes[inner - 1] = True
        keep = ~gap
        self.start = np.flatnonzero(opens & keep)
        self.end = np.flatnonzero(closes & keep) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def codes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` names one of two independent ones."""
        size = self.end - self.start
        padded = np.append(self.data, np.zeros(8, np.uint8))
        lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        factor = U64(WORD_FACTORS[which])
        out = mix(size.astype(U64) ^ U64(WORD_SEEDS[which]))
        out = mix(out + (lanes[self.start] & _MASK[np.minimum(size, 8)]) * factor)
        live, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(live):
            left = size[live] - done
            out[live] = mix(out[live] + (lanes[self.start[live] + done] & _MASK[np.minimum(left, 8)]) * factor)
            done += 8
            live = live[left > 8]
        for k in np.flatnonzero(size > LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(self.data[self.start[k] : self.end[k]].tobytes(), WORD_SEEDS[which])
        return out


def fold_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i that has a whole window."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` items that lie within one document."""
    n = int(first[-1])
    if n < width:
        return np.zeros(0, np.int64)
    last = np.repeat(first[1:], np.diff(first))[: n - width + 1]
    return np.flatnonzero(np.arange(n - width + 1) + width <= last)


def anchors(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window start the place of its least gram, leftmost on ties.

    A window's anchor depends on the window's content alone, so equal windows
    have equal anchors at equal offsets.
    """
    packed = (grams & U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U64)
    return (fold_min(packed, width)[starts] & U64(0xFFFFFFFF)).astype(np.int64)
