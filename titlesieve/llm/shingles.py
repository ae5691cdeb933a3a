"""Word shingles of whole texts as 64-bit hashes, computed over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_PIECE = 1 << 20  # bytes whose prefix sums are held at once
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public domain splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = max(_PIECE, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, pow(_BASE, -1, 1 << 64), dtype=_U)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def _hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of ``data``; words also end at ``breaks``."""
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_GAP[data]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    opens[at] |= inside[at + 1]
    closes[at - 1] |= inside[at]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U)), first


def word_hashes(text: np.ndarray) -> np.ndarray:
    """Of one text of any length: pieces end at a gap between words (or at the end of a longer word)."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text):
            gaps = np.flatnonzero(_GAP[text[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(at + 2 * (end - at), len(text))
        parts.append(_hashes(text[at:end], np.empty(0, dtype=np.int64))[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=_U)


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    out = np.zeros(max(len(words) - size + 1, 0), dtype=_U)
    for i in range(size):
        out = (out + words[i:len(words) - size + 1 + i]) * _U(_BASE)
    return mix(out)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words the whole sequence is one
    shingle; none for a null or a text without words. Case of A-Z does not count."""
    values = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(values):
        stop = max(int(np.searchsorted(offsets, offsets[row] + _PIECE, side="right")) - 1, row + 1)
        part = data[offsets[row]:offsets[stop]]
        if stop == row + 1:
            hashes, upto = word_hashes(part), None
            upto = np.array([0, len(hashes)])
        else:
            breaks = offsets[row:stop + 1] - offsets[row]
            hashes, first = _hashes(part, breaks)
            upto = np.searchsorted(first, breaks)
        for a, b in zip(upto, upto[1:]):
            n = int(b - a)
            yield np.unique(_grams(hashes[a:b], min(size, n))) if n else np.empty(0, dtype=_U)
        row = stop


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of a bounded number of text bytes (or one text), so that what is made of a piece is
    bounded too."""
    for batch in batches:
        size = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, n in enumerate(size):
            if i > at and total + n > 4 * _PIECE:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if batch.num_rows > at:
            yield batch.slice(at)
