"""Hashed word shingles of blocks of texts, as arrays."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import IN_WORD, LOWER

U = np.uint64
_STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Words of more bytes are hashed one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(_STEPS[0])
    x = (x ^ (x >> U(27))) * U(_STEPS[1])
    return x ^ (x >> U(31))


def _byte_hashes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each byte string of the buffer: its blocks of eight bytes, mixed in one after the other.

    No polynomial of the bytes: sums of powers modulo 2**64 make long words of a certain shape equal."""
    out = mixed(sizes.astype(U) * U(_STEPS[1]) + U(1))
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    blocks = np.lib.stride_tricks.as_strided(padded, (len(buffer) + 1, 8), (1, 1))
    live = np.flatnonzero(sizes <= LONG)
    at = 0
    while len(live):
        left = sizes[live] - at
        block = np.ascontiguousarray(blocks[starts[live] + at]).view(U)[:, 0]
        block &= U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U)))
        out[live] = mixed((out[live] ^ block) * U(_STEPS[0]) + U(at + 1))
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(sizes > LONG).tolist():
        word = buffer[starts[k] : starts[k] + sizes[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (A-Z lower-cased) in order, and the number of words of each text."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(n, np.int64)
    low = LOWER[raw]
    inside = IN_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = _byte_hashes(low, starts, ends - starts)
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of ``k`` words of each text, sorted within it, and their ends.

    A text of fewer words has its whole sequence as the only one; a text without words none.
    """
    words, counts = word_hashes(raw, offsets)
    n = len(counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(n), counts)
    factors = [U(pow(_STEPS[1], j + 1, 1 << 64)) for j in range(k)]
    mixture = np.zeros(len(words), U)
    for j in range(k):
        m = len(words) - j
        if m > 0:
            inside = owner[j:] == owner[:m]
            mixture[:m] += np.where(inside, (words[j:] + U(j)) * factors[j], U(0))
    # A shingle starts at each word with k - 1 more after it, or at the first word of a short text.
    place = np.arange(len(words)) - at[owner]
    starts = (place + k <= counts[owner]) | (place == 0)
    hashes, owner = mixed(mixture[starts] + np.minimum(counts[owner[starts]], k).astype(U)), owner[starts]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.cumsum(np.bincount(owner[new], minlength=n))
