"""Words of texts and hashes of word sequences, computed on whole byte buffers."""

from __future__ import annotations

import functools

import numpy as np

_U = np.uint64
# Fixed value: the bytes that separate words; no byte of a longer UTF-8 character is among them.
SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_CHECK_BASE = 0xD1342543DE82EF95
_INVERSE = {base: pow(base, -1, 1 << 64) for base in (_BASE, _CHECK_BASE)}
_SEED, _CHECK_SEED = 20240607, 20240608


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _byte_values(seed: int) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
    apart = np.zeros(256, dtype=bool)
    apart[list(SEPARATORS)] = True
    return values, apart


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(1 << max(20, int(n).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        held = np.cumprod(steps)
        if n <= 1 << 22:
            _powers[base] = held
    return held[:n]


class Words:
    """The words of some texts (null: none): ``hash``, ``owner`` (index of the text) and byte range of each.

    ``lower`` lower-cases A-Z first.  A word's hash is a polynomial of its bytes modulo 2^64, taken for all words at
    once from running sums, and scrambled with its length.
    """

    def __init__(self, texts: list[str | None], lower: bool):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buffer = b"\n".join([*parts, b""])
        if lower:
            self.buffer = self.buffer.translate(_LOWER)
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        _, apart = _byte_values(_SEED)
        inside = ~apart[data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = self._hashed(_SEED, _BASE)
        stops = np.cumsum([len(p) + 1 for p in parts])
        self.owner = np.searchsorted(stops, self.start, side="right")
        self.count = np.bincount(self.owner, minlength=len(texts))

    def _hashed(self, seed: int, base: int) -> np.ndarray:
        data = np.frombuffer(self.buffer, dtype=np.uint8)
        values, _ = _byte_values(seed)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * _power(base, len(data)), out=sums[1:])
        back = _power(_INVERSE[base], len(data) + 1)[self.start]
        return mix((sums[self.end] - sums[self.start]) * back + (self.end - self.start).astype(np.uint64))

    def rolling_check(self, size: int) -> np.ndarray:
        """Like ``rolling``, from other bytes' values, another base and other factors."""
        hashes = self._hashed(_CHECK_SEED, _CHECK_BASE)
        return rolling(hashes, size, _CHECK_SEED + size) if len(hashes) >= size else np.zeros(0, dtype=np.uint64)

    def rolling(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; those that run into the next text mean nothing."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return rolling(self.hash, size)


def rolling(hashes: np.ndarray, size: int, seed: int | None = None) -> np.ndarray:
    n = len(hashes) - size + 1
    factors = np.random.default_rng(size if seed is None else seed).integers(1, 1 << 62, size, dtype=np.uint64) * _U(2) + _U(1)
    total = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        total += hashes[j : j + n] * factors[j]
    return mix(total)


def shingle_sets(texts: list[str | None], size: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    A text with fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words = Words(texts, lower)
    rolled = words.rolling(size)
    stops = np.cumsum(words.count)
    sets = []
    for stop, n in zip(stops.tolist(), words.count.tolist(), strict=True):
        if n >= size:
            sets.append(np.unique(rolled[stop - n : stop - size + 1]))
        elif n:
            sets.append(rolling(words.hash[stop - n : stop], n))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
