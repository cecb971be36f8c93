"""Hashes of words and of runs of words, vectorised; used inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at a time, which bounds the memory a long text takes.
BLOCK = 1 << 20
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mixed(np.arange(1, 257, dtype=U))
_KEPT: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; the longest series so far is kept for the next text."""
    kept = _KEPT.get((base, inverse))
    if kept is None or len(kept) < n:
        kept = np.full(1 << max(12, int(n).bit_length()), U(pow(base, -1, 1 << 64) if inverse else base))
        kept[0] = U(1)
        _KEPT[base, inverse] = kept = np.multiply.accumulate(kept)
    return kept[:n]


def byte_set(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 flags."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def word_bounds(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word; ``gap`` flags the bytes that separate words."""
    edge = np.diff(gap[data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word; equal for equal bytes."""
    out = np.empty(len(starts), U)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        part = _BYTES[data[base : ends[last - 1]]]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers(_BYTE, len(part)), out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        value = (total[e] - total[s]) * powers(_BYTE, len(part) + 1, inverse=True)[s]
        out[first:last] = mixed(value + (e - s).astype(U))
        first = last
    return out


def text_words(text: str, gap: np.ndarray) -> np.ndarray:
    """The hashes of the words of a text, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return word_hashes(data, *word_bounds(data, gap))


def run_sums(words: np.ndarray) -> np.ndarray:
    """What ``run_hashes`` needs, once per text."""
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(_WORD, len(words)), out=total[1:])
    return total


def run_hashes(total: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """A 64-bit hash of the words from each start on, as many as ``lengths`` says."""
    value = (total[starts + lengths] - total[starts]) * powers(_WORD, len(total), inverse=True)[starts]
    return mixed(value + np.asarray(lengths, np.int64).astype(U))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
