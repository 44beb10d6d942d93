"""A minimal perfect hash over 64-bit keys (Limasset et al., 2017), kept as plain arrays.

Level by level, keys hash into a bit array of twice their number; keys alone on their bit stay there, the others go to
the next level. The rank of a key's bit among all set bits is its slot, so n keys use exactly the slots 0..n-1.
"""

from __future__ import annotations

import numpy as np

from tidewatch.llm.text import mixed

_STEP = np.uint64(0xD1B54A32D192ED03)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(int(_STEP) * (level + 1) % (1 << 64))
    return (mixed(keys ^ seed) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys + _STEP) >> np.uint64(32)).astype(np.uint32)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels as bytes) for distinct uint64 keys."""
    sizes, bits = [], []
    while len(keys):
        size = max(64, 2 * len(keys) + 63 & ~63)
        place = _place(keys, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[place]]
    flags = np.concatenate(bits) if bits else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(flags, bitorder="little")


class Index:
    """Slots of keys, by the arrays that build() made. Rank sums per 64-bit word keep a lookup constant-time."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes = sizes
        self.words = np.frombuffer(bits.tobytes(), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key of the build; for other keys any slot, or -1."""
        found, base, open_ = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = base + _place(keys[open_], level, int(size))
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
            base += int(size)
        return found
