"""Polynomial hashes over byte arrays, and vectorised words."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Odd base of the polynomial hashes, modulo 2^64.
BASE = 0x9E3779B97F4A7C15


@cache
def powers(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below 2^bits, and a random odd value for each byte."""
    n = 1 << bits
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), values


class Prefixes:
    """Prefix polynomial hashes of a byte array: the hash of any string in constant time, wherever it stands."""

    def __init__(self, data: np.ndarray):
        self.up, down, values = powers(max(12, int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * down[: len(data)], out=self.sums[1:])

    def hashes(self, at: np.ndarray, n) -> np.ndarray:
        """Of the n bytes from each place. The sums hold BASE^-i at place i; BASE^at brings a string back to place zero."""
        return (self.sums[at + n] - self.sums[at]) * self.up[at]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads a hash over all 64 bits."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the Latin-1 letters of UTF-8 (U+00C0 to U+00DE)."""
    low = _FOLD[data]
    if len(low) > 1:
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of each word: runs of ASCII letters, digits and bytes of other characters, in lower case. Bytes count from each text's start."""
    data = fold(np.frombuffer(b"\0".join(texts) + b"\0", np.uint8))
    inside = np.concatenate([[False], _WORD[data]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    hashes = mix(Prefixes(data).hashes(starts, ends - starts))
    begin = np.cumsum([0, *[len(t) + 1 for t in texts]])
    number = np.searchsorted(begin, starts, side="right") - 1
    return hashes, number, starts - begin[number], ends - begin[number]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : i + m]
    return mix(out)
