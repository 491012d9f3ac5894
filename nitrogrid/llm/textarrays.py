"""Texts of a batch as flat numpy arrays: words, their hashes, and window hashes."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from nitrogrid.llm.common import byte_view, mixed

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(n: int, which: str = "up") -> np.ndarray:
    """BASE (or its inverse) to the powers 0 to n - 1, modulo 2^64."""
    held = _powers.get(which)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 16), BASE if which == "up" else INVERSE, np.uint64)
        steps[0] = 1
        held = _powers[which] = np.cumprod(steps)
    return held[:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash, modulo 2^64, of values[start:end] for many ranges."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=total[1:])
    return (total[end] - total[start]) * powers(len(values) + 1, "down")[start]


_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = (np.uint64(0x8C5F9A3B1D2E4F67), np.uint64(0x27D4EB2F165667C5))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
BLOCKS = 8  # blocks of eight bytes of words that are hashed together; longer words go one by one


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, stream: int) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], by mixing its blocks of eight bytes; two independent streams."""
    size = end - start
    found = mixed(size.astype(np.uint64) + _SEEDS[stream])
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    long = size > 8 * BLOCKS
    left = np.flatnonzero((size > 0) & ~long)
    for k in range(BLOCKS):
        left = left[size[left] > 8 * k]
        if not len(left):
            break
        block = np.ascontiguousarray(eights[start[left] + 8 * k]).view(np.uint64).ravel()
        block &= _MASKS[np.minimum(size[left] - 8 * k, 8)]
        found[left] = mixed(found[left] * _OTHER + block)
    for i in np.flatnonzero(long).tolist():
        digest = hashlib.blake2b(raw[start[i]:end[i]].tobytes(), digest_size=16).digest()
        found[i] = np.frombuffer(digest, np.uint64)[stream]
    return found


@dataclass
class Words:
    hashes: np.ndarray   # one 64-bit hash per word
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # byte after each word
    first: np.ndarray    # for each document the number of its first word; one more entry than documents
    raw: np.ndarray      # the bytes of all texts

    @cached_property
    def second(self) -> np.ndarray:
        """A second hash of each word, independent of the first."""
        return word_hashes(self.raw, self.start, self.end, 1)


def words(column: pa.Array) -> Words:
    """The words (runs of other than white space) of a text column."""
    raw, offsets = byte_view(column)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    end = np.flatnonzero(ends) + 1
    return Words(word_hashes(raw, start, end, 0), start, end, np.searchsorted(start, offsets), raw)

