"""Word and shingle hashes of many texts at once, with numpy on the bytes of an Arrow batch.

Words are runs without ASCII white space, A-Z lower-cased. A word's hash is a
polynomial in its bytes modulo 2^64, taken as a difference of prefix sums, so a
batch costs a few passes over its bytes whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text whose working arrays are held at once (one longer text alone may exceed it).
CHUNK = 1 << 19

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _random.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_light(x: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
    """One of a family of hashes of well-mixed 64-bit integers; its high bits are the good ones."""
    return (x ^ shift) * factor


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; kept up to a chunk's length."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 4096), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= CHUNK + 4096:
            _powers[int(base)] = known
    return known[:n]


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"") + 1
        if size >= CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def spans(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts in a row, begin and end of each word, and each text's first word (n + 1 bounds)."""
    lowered = [(t or b"").lower() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *lowered, b""]), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # texts begin and end with a line feed
    begin, end = edge[0::2], edge[1::2]
    offsets = np.cumsum([1, *(len(t) + 1 for t in lowered)])
    return data, begin, end, np.searchsorted(begin, offsets)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and each text's first word (n + 1 bounds)."""
    data, begin, end, bounds = spans(texts)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, len(data)), dtype=np.uint64)])
    return mixed((total[end] - total[begin]) * powers(INVERSE, len(data))[begin]), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of ``width`` words inside a text (fewer words: the whole sequence), and n + 1 bounds."""
    counts = np.diff(bounds)
    each = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    firsts = np.concatenate([[0], np.cumsum(each)])
    start = np.arange(firsts[-1]) + np.repeat(bounds[:-1] - firsts[:-1], each)
    room = np.repeat(bounds[1:], each) - start  # words left in the text
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(start), np.uint64)
    for k in range(width):
        total += np.where(room > k, padded[start + k], np.uint64(0)) * _PLACE[k]
    return mixed(total), firsts


def sequence_hashes(words: np.ndarray, bounds: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's whole word sequence."""
    base = np.uint64(0xD1B54A32D192ED03 + 2 * seed)  # odd
    counts = np.diff(bounds)
    at = np.arange(len(words)) - np.repeat(bounds[:-1], counts)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
        mixed(words + np.uint64(seed)) * powers(base, int(counts.max(initial=1)) + 1)[at], dtype=np.uint64)])
    return mixed(run[bounds[1:]] - run[bounds[:-1]] + counts.astype(np.uint64))
