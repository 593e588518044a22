"""Hashes of all words of many texts at once, and of runs of words, in numpy.

A word is a run of bytes other than space and U+0009 to U+000D. Its hash is a polynomial in its bytes modulo 2**64,
taken from running sums over the whole batch, and mixed; runs of words combine word hashes the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 1 << 21

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BATCH_BYTES + 1)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, BASE, dtype=np.uint64))])
        _inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, back, dtype=np.uint64))])
    return _powers, _inverse


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, encoded texts) in groups of about BATCH_BYTES; a longer text is a group of its own."""
    start, size, held = 0, 0, []
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > BATCH_BYTES:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text)."""
    joined = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    inside = (joined != 32) & ((joined < 9) | (joined > 13))
    edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    powers, inverse = _tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers[: len(joined)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(t) for t in texts], dtype=np.int64) + 1
    limits = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.diff(np.searchsorted(starts, limits))
    return hashes, counts


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each word on; those that would pass the end are left out."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    done, width, part = 0, 1, hashes
    with np.errstate(over="ignore"):
        # Doubling: `part` holds runs of `width` words; the binary digits of the length say which are used.
        rest = length
        while rest:
            if rest & 1:
                out += part[done : done + n] * np.uint64(pow(int(BASE), done, 1 << 64))
                done += width
            rest >>= 1
            if rest:
                part = part[:-width] + part[width:] * np.uint64(pow(int(BASE), width, 1 << 64))
                width *= 2
    return mix(out)
