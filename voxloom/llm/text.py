"""Words and their hashes for whole Arrow batches of texts, in numpy.

A text is looked at as UTF-8 bytes. The bytes of all texts of a slice lie in one array, so that finding words and hashing
them takes a few passes over the array instead of a Python step for each word. Slices hold about ``SLICE_BYTES`` of text;
a longer text makes a slice of its own, and its words are hashed in blocks, so memory stays at a few bytes a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 19
#: bytes 0x09-0x0D and 0x20 part words
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of the public SplitMix64)."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each."""
    offsets = _offsets(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32) if column.buffers()[1] else np.zeros(1, np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def filled(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.fill_null("") if column.null_count else column


class Texts:
    """The bytes of some texts, and where each text begins and ends."""

    def __init__(self, column: pa.Array):
        offsets = _offsets(column)
        data = column.buffers()[2]
        self.bytes = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def words(self, gaps: np.ndarray = SPACES) -> Words:
        """Maximal runs of bytes that ``gaps`` doesn't hold; no word goes beyond its text."""
        inside = ~gaps[self.bytes]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return Words(self, starts, ends)


class Words:
    """Word k is bytes[starts[k]:ends[k]]; the words of text d are first[d]:first[d + 1]."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, texts.offsets)
        self.counts = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, after ``fold`` (a table of 256 bytes) where given."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = self.starts[at]
            end = max(at + 1, int(np.searchsorted(self.ends, low + _BLOCK, side="right")))
            high = self.ends[end - 1]
            raw = self.texts.bytes[low:high]
            raw = (fold[raw] if fold is not None else raw).astype(np.uint64) + np.uint64(1)
            if high - low > _BLOCK:  # one word longer than a block: block by block
                total = np.uint64(0)
                for part in range(0, len(raw), _BLOCK):
                    piece = raw[part : part + _BLOCK]
                    total = mix(np.array([total + (piece * _UP[: len(piece)]).sum(dtype=np.uint64)], np.uint64))[0]
                out[at] = total
            else:
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(raw * _UP[: len(raw)], out=sums[1:])
                s, e = self.starts[at:end] - low, self.ends[at:end] - low
                out[at:end] = (sums[e] - sums[s]) * _DOWN[s]
            at = end
        return mix(out)

    def shingles(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each run of ``size`` words; a text with fewer words, but one at least, is one shingle."""
        n, owner = len(hashes), self.text_of()
        total = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            total = mix(total ^ hashes[k : n - size + 1 + k]) if n >= size else total
        whole = owner[: len(total)] == owner[size - 1 :] if n >= size else np.zeros(0, bool)
        docs, keys = owner[: len(total)][whole], total[whole]
        few = np.flatnonzero((self.counts > 0) & (self.counts < size))
        if len(few):
            short = np.full(len(few), 1, np.uint64)
            for k in range(size - 1):
                has = self.counts[few] > k
                short[has] = mix(short[has] ^ hashes[self.first[few[has]] + k])
            docs, keys = np.concatenate([docs, few]), np.concatenate([keys, short])
        return docs, keys


def counted(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of each distinct pair, by text."""
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return docs[at], keys[at], np.diff(np.append(at, len(keys)))
