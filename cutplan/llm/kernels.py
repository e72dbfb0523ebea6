"""Vectorised word and byte hashing for Arrow batches; what runs inside a task.

A batch is worked through in blocks of about `BLOCK` bytes, so memory in a worker doesn't grow with
the number of rows in a batch.  A document longer than a block is hashed in pieces cut between words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on uint64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % 2**64))


#: One random number a byte value; polynomial base and its inverse modulo 2**64.
BYTE = randoms(256, 1)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next block."""
    if len(have := _powers.get(base, np.zeros(0, U))) < n:
        steps = np.full(max(n, BLOCK * 2), base, U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [b or b"" for b in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """[lo, hi) of consecutive rows of about `size` bytes together; a longer text stands alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWERED = lower_table()
UNCHANGED = np.arange(256, dtype=np.uint8)
#: Word bytes of `[^\x20\x09-\x0D]+`, and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _hash_block(joined: bytes, word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = fold[np.frombuffer(joined, np.uint8)]
    inside = word[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=U, out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * powers(INVERSE, len(data) + 1)[start])


def _pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """Pieces of a long text, cut at a blank or line end."""
    at = 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(b" ", at, at + BLOCK), text.rfind(b"\n", at, at + BLOCK))
        if cut <= at:
            nexts = [p for p in (text.find(b" ", at + BLOCK), text.find(b"\n", at + BLOCK)) if p > 0]
            cut = min(nexts, default=len(text))
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


def words(texts: list[bytes], word: np.ndarray, fold: np.ndarray = LOWERED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of one block of texts: (hash, start, end, bounds); text i has words bounds[i]:bounds[i+1].

    start and end are byte positions in the texts joined by one blank.  `fold` maps bytes before they're hashed.
    """
    if len(texts) == 1 and len(texts[0]) > BLOCK:
        parts = [(at, *_hash_block(p, word, fold)) for at, p in _pieces(texts[0])]
        start = np.concatenate([s + at for at, s, _, _ in parts])
        end = np.concatenate([e + at for at, _, e, _ in parts])
        hashed = np.concatenate([h for *_, h in parts])
    else:
        start, end, hashed = _hash_block(b" ".join(texts), word, fold)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return hashed, start, end, bounds


def shingles(hashed: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of runs of n words, sorted; fewer words are one run; none gives none."""
    if len(hashed) == 0:
        return np.zeros(0, U)
    size = min(n, len(hashed))
    factors = randoms(size, 1000 + size) | U(1)
    total = np.zeros(len(hashed) - size + 1, U)
    for i in range(size):
        total += hashed[i : len(hashed) - size + 1 + i] * factors[i]
    return np.unique(mix(total))


def digest16(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()
