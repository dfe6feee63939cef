"""Sets of word shingles as 64-bit hashes, worked out on the bytes of a text with numpy."""

from __future__ import annotations

import numpy as np

_WRAP = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
#: A random number for each byte (letters A-Z share those of a-z), and odd multipliers.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _WRAP(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE, _PLACE = 0x9E3779B97F4A7C15, _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _WRAP(2) + _WRAP(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number (a fixed bijection)."""
    x = (x ^ (x >> _WRAP(30))) * _WRAP(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _WRAP(27))) * _WRAP(0x94D049BB133111EB)
    return x ^ (x >> _WRAP(31))


_WORD = np.zeros(256, np.int8)
_WORD[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = 1


def bare_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of runs of letters, digits and characters beyond ASCII, in lower case."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = _WORD[data]
    step = np.diff(word)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return span_hashes(data, starts, ends), starts, ends


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words between ASCII white space."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_SPACE[data]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, A-Z like a-z: a polynomial in prefix sums, then mixed with the length."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(data, *word_spans(data))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, in order; of the whole sequence if there are fewer words."""
    if not len(words):
        return words
    if len(words) < size:
        return mix(np.array([(words * _PLACE[32 : 32 + len(words)]).sum() + _WRAP(len(words))], np.uint64))
    out = words[: len(words) - size + 1] * _PLACE[0]
    for k in range(1, size):
        out += words[k : len(words) - size + 1 + k] * _PLACE[k]
    return mix(out)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty if it has no words."""
    return np.unique(shingle_hashes(word_hashes(text), size))
