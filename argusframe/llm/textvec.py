"""Vectorised byte and word hashing of many texts at once, for use inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}
#: Bytes of text that are hashed at once; a longer text makes a larger chunk of its own.
CHUNK_BYTES = 2 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads polynomial hashes over all 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**i before each position; one more than the bytes."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) of runs of rows of about ``most`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Bytes from which a word's hash is a digest: polynomials modulo 2**64 collide on some long regular words.
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space) of the rows, and where each row's words begin (one more than rows)."""
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = offsets[:-1][(offsets[:-1] < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = word[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    found = span_hashes(prefix_sums(data), starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_WORD).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return found, np.searchsorted(starts, offsets)


def shingle_sets(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each row; a row of fewer words has one, of all its words; one without words none."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - k + 1), U)
    up, _ = powers(k + 1)
    for j in range(k):
        rolled += hashes[j : n - k + 1 + j] * up[j + 1] if n >= k else U(0)
    rolled = mix(rolled + U(k))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short, _ = powers(b - a + 1)
            yield mix(np.array([int((hashes[a:b] * short[1:]).sum() + U(b - a))], U))
        else:
            yield np.zeros(0, U)
