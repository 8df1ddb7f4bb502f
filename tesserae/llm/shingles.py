"""Words and hashed shingles of texts in numpy, without a Python step for each word."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random odd-or-even 64-bit value for each byte, and the odd bases of the two polynomials.
BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(kind: str, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = BASE if kind == "base" else INVERSE
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: differences of a prefix polynomial, shifted back to the word's start."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers("base", len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers("inverse", len(data) + 1)[starts])


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words; none if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for k in range(1, width):
        total *= STEP
        total += words[k : k + n]
    return mix(total)
