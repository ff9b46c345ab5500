"""Columnar text toolkit: the texts of an Arrow batch as one byte array.

Every operator of this subpackage that has to look inside texts does so on
blocks of about a megabyte of concatenated UTF-8, with NumPy over bytes and
words, never a Python loop over words.  A block keeps whole texts, however
long: a text larger than the target size is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; small enough for the CPU caches.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _byte_values() -> np.ndarray:
    out, x = [], 0x243F6A8885A308D3
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x ^ (x >> 29))
    return np.array(out, dtype=np.uint64)


VALUES = _byte_values()

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

IS_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def grow(base: int) -> np.ndarray:
        out = np.ones(n, dtype=np.uint64)
        out[1:] = np.uint64(base)
        return np.cumprod(out, dtype=np.uint64)

    return grow(_BASE), grow(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least."""
    size = BLOCK_BYTES * 2
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX
    x ^= x >> np.uint64(32)
    return x


class Block:
    """Texts as bytes: ``data`` holds text i in ``offsets[i]:offsets[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def folded(self) -> np.ndarray:
        """Lower case for ASCII and Latin-1 letters; other scripts stay as they are."""
        if not hasattr(self, "_folded"):
            out = FOLD[self.data]
            lead = np.flatnonzero(self.data[:-1] == 0xC3) if len(self.data) else np.empty(0, np.int64)
            if len(lead):
                nxt = self.data[lead + 1]
                up = lead[(nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
                out[up] += 32
            self._folded = out
        return self._folded

    def word_mask(self) -> np.ndarray:
        """True on bytes of words: letters, digits and what isn't ASCII, without general punctuation."""
        mask = IS_WORD[self.folded]
        if len(mask):
            at = np.flatnonzero(self.data == 0xC2)
            at = at[at + 1 < len(mask)]
            mask[at] = False
            mask[at + 1] = False
            at = np.flatnonzero(self.data[:-2] == 0xE2) if len(mask) > 2 else at[:0]
            at = at[self.data[at + 1] == 0x80]
            for k in range(3):
                mask[at + k] = False
        return mask

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True, and where each text's runs begin; no run crosses texts."""
        begin, end = mask.copy(), mask.copy()
        if len(mask):
            begin[1:] &= ~mask[:-1]
            end[:-1] &= ~mask[1:]
            full = self.offsets[1:] > self.offsets[:-1]
            at = self.offsets[:-1][full]
            begin[at] = mask[at]
            at = self.offsets[1:][full] - 1
            end[at] = mask[at]
        starts = np.flatnonzero(begin)
        return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "_words"):
            self._words = self.runs(self.word_mask())
        return self._words

    def prefix_hash(self, data: np.ndarray | None = None) -> np.ndarray:
        """H with H[e] - H[s] times B**-s a hash of bytes s:e."""
        data = self.folded if data is None else data
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(VALUES[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return span_hash(self.prefix_hash(), starts, ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n folded words, and where each text's begin.

        A text of 1 to n-1 words has one gram, all its words; a text without words has none.
        """
        words = self.word_hashes()
        bounds = self.words()[2]
        count = np.diff(bounds)
        per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
        out_bounds = np.concatenate(([0], np.cumsum(per)))
        first = np.repeat(bounds[:-1] - out_bounds[:-1], per) + np.arange(out_bounds[-1])
        last = np.repeat(bounds[1:], per)
        acc = np.zeros(len(first), dtype=np.uint64)
        padded = np.concatenate((words, np.zeros(n, dtype=np.uint64)))
        for k in range(n):
            at = first + k
            acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(at < last, padded[at], np.uint64(k + 1))
        return mix(acc), out_bounds


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans from a prefix hash; equal bytes have equal hashes wherever they are."""
    inverse = powers(len(prefix))[1]
    size = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + size * np.uint64(0x165667B19E3779F9))


def block_of(texts: pa.Array, first: int = 0) -> Block:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return Block(np.empty(0, np.uint8), np.zeros(1, np.int64), first)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return Block(data, offsets - offsets[0], first)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive blocks of about ``size`` bytes; ``first`` is the index of a block's first text."""
    whole = block_of(texts)
    at = 0
    while at < len(whole):
        to = int(np.searchsorted(whole.offsets, whole.offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(whole))
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield Block(whole.data[lo:hi], whole.offsets[at : to + 1] - lo, at)
        at = to


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values by text; 0 for an empty text."""
    total = np.concatenate((np.zeros(1, dtype=np.result_type(values.dtype, np.int64)), np.cumsum(values, dtype=np.result_type(values.dtype, np.int64))))
    return total[bounds[1:]] - total[bounds[:-1]]
