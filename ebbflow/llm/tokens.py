"""Hashes of all words of a batch of texts, by array arithmetic on its bytes.

A word's hash is the sum of byte * BASE**position mod 2**64, mixed; powers of
the odd base have inverses, so one running power over the batch serves words
at any place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Bytes of text worked on at once (one text is never cut).
PORTION = 1 << 18


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, PORTION), base, U)
        have[0] = U(1)
        have = np.cumprod(have, dtype=U)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_classes(words_of: str) -> np.ndarray:
    """Value of each byte, 0 for separators.  ``space``: words are runs of
    anything but ASCII white space; ``letters``: runs of ASCII letters, digits
    and bytes of other scripts.  A-Z count as a-z."""
    v = np.arange(1, 257, dtype=U)
    v[65:91] = v[97:123]
    if words_of == "space":
        v[[32, 9, 10, 11, 12, 13]] = 0
    else:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        v[~keep] = 0
    return v


SPACE, LETTERS = byte_classes("space"), byte_classes("letters")


def portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about PORTION
    bytes; null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + PORTION, "right")) - 1)
        yield row, end, raw[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, text number) of every word; ``offsets`` bound the texts."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = classes[data]
    inside = value != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    first[bounds] = inside[bounds]
    start = np.flatnonzero(first)
    if not len(start):
        return np.zeros(0, U), start, start
    total = np.add.reduceat(value * _power(_BASE, len(data), "up"), start)
    return mix(total * _power(_INVERSE, len(data), "down")[start]), start, np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (order counts)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for i in range(size):
        h = h * _BASE + words[i:i + n]
    return mix(h)
