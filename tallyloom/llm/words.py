"""Word and shingle hashes of Arrow text batches, computed in numpy on the UTF-8 bytes.

Words are runs of bytes other than space and ``\\x09-\\x0D``; A-Z count as a-z; everything else is compared as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value = constants(256, 11)
    value[65:91] = value[97:123]
    value[space] = 0
    return space, value


_powers: list[np.ndarray] = []
#: A prime, and a base for it: words that agree modulo 2**64 whatever its base, which there are, still differ here.
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_234_567_891
_prime_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size, inverse = max(n, CHUNK_BYTES) + 1, pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _prime_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo the prime."""
    if not _prime_powers or len(_prime_powers[0]) <= n:
        size, out = max(n, CHUNK_BYTES) + 1, []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME)):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), _PRIME)) % np.uint64(_PRIME)])
            out.append(table[:size])
        _prime_powers[:] = out
    return _prime_powers[0], _prime_powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about CHUNK_BYTES together."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        yield at, min(to, n)
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the first word of each row (one more than rows), and where words start and end."""
    space, value = _tables()
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts_here = ~blank
    starts_here[1:] &= blank[:-1] | edge[1:n]
    ends_here = ~blank
    ends_here[:-1] &= blank[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * power[:n], out=sums[1:])
    found = mix64((sums[ends] - sums[starts]) * inverse[starts])
    prime, (power, inverse) = np.uint64(_PRIME), _prime_tables(n)
    small = (value >> np.uint64(33)).astype(np.uint64)
    terms = small[data] * power[:n]  # under 2**62; folded by 31 bits, which keeps the remainder
    np.cumsum((terms & prime) + (terms >> np.uint64(31)), out=sums[1:])
    found ^= mix64((sums[ends] - sums[starts]) % prime * inverse[starts] % prime + np.uint64(1) << np.uint64(32))
    return found, np.searchsorted(starts, offsets), starts, ends


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the distinct hashes of its runs of ``width`` words, sorted; with fewer words, of all its words; without, none."""
    times = constants(width, 23)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        runs += words[j : j + len(runs)] * times[j]
    runs = mix64(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield mix64((words[a:b] * times[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield runs[:0]
