"""Words, word hashes and shingles of whole texts, found on the UTF-8 bytes of an Arrow column with array arithmetic.

No Python string is made for a word: a text column is one byte buffer with offsets, a word is a run of bytes of one
class, and its 64-bit hash is a difference of two prefix sums of the polynomial hash of the buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd multiplier and its inverse modulo 2**64, so that powers can be divided away.
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Texts are scanned together up to this many bytes; one longer text is scanned alone and whole.
BLOCK_BYTES = 4 << 20

_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers[kind]
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def byte_class(inside) -> np.ndarray:
    """A table of 256 flags from a predicate on the byte's value, after A-Z have become a-z."""
    return np.array([bool(inside(b + 32 if 65 <= b <= 90 else b)) for b in range(256)])


#: Runs of anything but ASCII white space.
SPACED = byte_class(lambda b: b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))
#: Runs of digits, letters and everything beyond ASCII.
ALNUM = byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of a run of texts: text i has words first[i] to first[i + 1]."""

    first: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    prefixes: dict[int, tuple[np.ndarray, np.ndarray]]  # by bytes: the longer words, and a hash of what they begin with

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(first row, offsets, bytes) of runs of whole texts of up to `most` bytes."""
    offsets, data = string_buffer(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, offsets[row : stop + 1] - offsets[row], data[offsets[row] : offsets[stop]]
        row = stop


def words(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of the texts between `offsets`; no word crosses from one text to the next."""
    n = len(data)
    flags = np.empty(n + 1, bool)
    flags[:n] = inside[data]
    flags[n] = False
    starts = flags[:n].copy()
    starts[1:] &= ~flags[: n - 1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    starts[inner] = flags[inner]
    ends = flags[:n] & ~flags[1:]
    last = inner - 1
    ends[last] = flags[last]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((_LOWER[data].astype(U64) + U64(1)) * _power("p", _MULTIPLIER, n), out=sums[1:])
        raw = (sums[end] - sums[begin]) * _power("i", _INVERSE, n + 1)[begin]
        hashes = mix(raw + (end - begin).astype(U64) * U64(0xD1B54A32D192ED03))
        heads = {}
        for k in prefixes:
            longer = np.flatnonzero(end - begin > k)
            at = begin[longer]
            heads[k] = longer, mix((sums[at + k] - sums[at]) * _power("i", _INVERSE, n + 1)[at] ^ U64(0xC4CEB9FE1A85EC53 + k))
    return Words(np.searchsorted(begin, offsets), hashes, begin, end, heads)


def shingles(found: Words, k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes; a text of fewer words, but not none, has one."""
    out, h = [], found.hashes
    with np.errstate(over="ignore"):
        run = np.zeros(max(len(h) - k + 1, 0), U64)
        for i in range(k):
            run = mix(run * U64(0x100000001B3) + h[i : i + len(run)])
        run = mix(run + U64(k))
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                x = U64(0)
                for i in range(a, b):
                    x = mix(np.array([x * U64(0x100000001B3) + h[i]]))[0]
                out.append(mix(np.array([x + U64(b - a)])))
        else:
            out.append(np.zeros(0, U64))
    return out
