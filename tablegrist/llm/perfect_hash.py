"""A minimal perfect hash of integer keys, with the keys kept for verification."""

from __future__ import annotations

import numpy as np

from tablegrist.llm.grams import mixed

_GOLD = 0x9E3779B97F4A7C15
#: Bits of a level for each key that comes to it, and the levels tried; keys that
#: still collide are kept in a sorted list behind the others.
ROOM, LEVELS = 2, 24


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys.

    Each level has a field of bits. A key that is alone at its place of a level
    sets the bit there and is done; the others go on to the next level. A key's
    number is the rank of its bit among all set bits. The keys are kept in order
    of their numbers, so that a key that is none of them is told apart."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(keys.astype(np.int64))
        self.levels: list[np.ndarray] = []
        self.before: list[np.ndarray] = []  # set bits before each place
        placed, left = [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = ROOM * len(left)
            at = self._places(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            fine = alone[at]
            done, places = left[fine], at[fine]
            placed.append(done[np.argsort(places)])
            self.levels.append(np.packbits(alone, bitorder="little"))
            self.before.append(size)
            left = left[~fine]
        placed.append(left)
        self.keys = np.concatenate(placed) if placed else keys
        self.rest = len(left)
        self._rank()

    def _rank(self) -> None:
        """For every byte of every level, the set bits that come before it."""
        self.sizes, ranks, since = list(self.before), [], 0
        for bits in self.levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            ranks.append(since + np.cumsum(ones) - ones)
            since += int(ones.sum())
        self.before = ranks

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = mixed(keys.astype(np.uint64) + np.uint64((level + 1) * _GOLD % 2**64))
        return (h % np.uint64(size)).astype(np.int64)

    def state(self) -> dict:
        """What ``restored`` needs, plain values only."""
        return vars(self)

    @classmethod
    def restored(cls, state: dict) -> PerfectHash:
        made = cls.__new__(cls)
        vars(made).update(state)
        return made

    def __len__(self) -> int:
        return len(self.keys)

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + sum(x.nbytes for x in (*self.levels, *self.before))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for what is none of the hash's keys."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before, size) in enumerate(zip(self.levels, self.before, self.sizes)):
            if not len(todo):
                break
            at = self._places(keys[todo], level, size)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            fine = byte >> bit & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            out[todo[fine]] = before[at[fine] >> 3] + below[fine]
            todo = todo[~fine]
        if self.rest and len(todo):
            tail = self.keys[-self.rest :]
            at = np.minimum(np.searchsorted(tail, keys[todo]), self.rest - 1)
            out[todo] = len(self.keys) - self.rest + at
        fine = out >= 0
        out[fine] = np.where(self.keys[out[fine]] == keys[fine], out[fine], -1)
        return out
