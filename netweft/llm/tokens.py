"""Words and word hashes of whole Arrow text columns, computed with numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return (``[^\\x20\\x09-\\x0D]+``); on UTF-8 that equals the same rule on characters. Texts are never
cut: a block holds whole documents, at least one.

Hashes are 64 bits wide. A word's eight-byte pieces are each mixed with their place and summed, and the
sum is mixed with the word's length: no algebra of the bytes survives, words of up to eight bytes and equal length
never share a hash, and equal words have equal hashes on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time (a longer document makes a block of its own).
BLOCK = 1 << 20

_R = 0x9E3779B97F4A7C15
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Of a word's last eight bytes those that belong to it, by their number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Some whole documents: ``rows`` in the batch, lower-cased bytes, words and their bounds.

    ``start``/``end`` are byte positions of words in ``data``; words of document k are those from
    ``first[k]`` to ``first[k + 1]``.
    """

    def __init__(self, rows: range, data: np.ndarray, bounds: np.ndarray, lower: bool) -> None:
        self.rows, self.data, self.bounds = rows, _LOWER[data] if lower else data, bounds
        n = len(data)
        inside = ~_SPACE[data]
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            before[bounds[:-1][bounds[:-1] < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            last = bounds[1:][bounds[1:] > 0] - 1
            after[last] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, _U)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each position on
        x = mix(eight[self.start].astype(_U) & _MASK[np.minimum(size, 8)] ^ _place(np.zeros(1, np.int64)))
        long = np.flatnonzero(size > 8)
        if len(long):
            pieces = (size[long] - 1) >> 3  # those after the first
            first = np.cumsum(pieces) - pieces
            word = np.repeat(long, pieces)
            k = np.arange(len(word)) - np.repeat(first, pieces) + 1
            rest = eight[self.start[word] + 8 * k].astype(_U) & _MASK[np.minimum(size[word] - 8 * k, 8)]
            x[long] += np.add.reduceat(mix(rest ^ _place(k)), first)
        return mix(x + size.astype(_U))


def _place(k: np.ndarray) -> np.ndarray:
    """What a piece is mixed with by its place in the word."""
    return mix(k.astype(_U) * _U(_R) + _U(0xA0761D6478BD642F))


def blocks(texts: pa.Array, lower: bool = True, size: int = BLOCK) -> Iterator[Block]:
    """Whole documents of a string column in blocks of about ``size`` bytes; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield Block(range(k, stop), whole[at[k] : at[stop]], at[k : stop + 1] - at[k], lower)
        k = stop


def shingles(block: Block, words: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word windows; short ones make one window."""
    h = block.hashes()
    factors = mix(np.arange(1, words + 1, dtype=_U) * _U(_R)) | _U(1)
    n = len(h)
    rolled = np.zeros(max(n - words + 1, 0), _U)
    for k in range(words):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = mix(rolled)
    for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(rolled[a : b - words + 1])
        elif b > a:
            yield mix((h[a:b] * factors[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, _U)
