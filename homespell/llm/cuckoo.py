"""Cuckoo filters over 64-bit keys, many at a time.

A key has a print of 16 bits and two buckets of four slots; either bucket follows from the other and the print,
so a stored print can be moved or taken out without its key. The filter answers "not here" for sure and "here" with a
chance of error of about 2^-13; whoever uses it keeps the exact keys, from which it is built anew when it overflows.
"""

from __future__ import annotations

import numpy as np

from homespell.llm.text import mix

SLOTS = 4
#: Share of the slots that are taken when a filter is made, and the rounds of moves after which an insertion gives up.
LOAD, ROUNDS = 0.75, 500
LEAST_BUCKETS = 64


class CuckooFilter:
    def __init__(self, table: np.ndarray):
        """``table``: prints by bucket and slot, 0 where a slot is free; its first side is a power of two."""
        self.table = table

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        buckets = LEAST_BUCKETS
        while buckets * SLOTS * LOAD < len(keys):
            buckets *= 2
        while True:
            made = cls(np.zeros((buckets, SLOTS), np.uint16))
            if made.insert(keys):
                return made
            buckets *= 2

    def _prints(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.maximum(keys >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        return prints, (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(prints.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def room_for(self, more: int) -> bool:
        return int((self.table > 0).sum()) + more <= 0.9 * self.table.size

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, bucket = self._prints(keys)
        one = (self.table[bucket] == prints[:, None]).any(axis=1)
        return one | (self.table[self._other(bucket, prints)] == prints[:, None]).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False where the filter overflows; it then has lost prints and must be built anew."""
        prints, bucket = self._prints(keys)
        other = self._other(bucket, prints)
        bucket = np.where((self.table[bucket] == 0).any(axis=1), bucket, other)
        for turn in range(ROUNDS):
            if not len(prints):
                return True
            # One print a bucket and round: no two take the same slot.
            _, own = np.unique(bucket, return_index=True)
            free = self.table[bucket[own]] == 0
            fits = free.any(axis=1)
            placed, full = own[fits], own[~fits]
            self.table[bucket[placed], free[fits].argmax(axis=1)] = prints[placed]
            slot = (bucket[full] + turn) % SLOTS
            moved = self.table[bucket[full], slot]
            self.table[bucket[full], slot] = prints[full]
            prints[full], bucket[full] = moved, self._other(bucket[full], moved)
            stay = np.ones(len(prints), bool)
            stay[placed] = False
            prints, bucket = prints[stay], bucket[stay]
        return not len(prints)

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted; others raise."""
        prints, bucket = self._prints(keys)
        other = self._other(bucket, prints)
        while len(prints):
            # Keys of one print and one pair of buckets are told apart by nothing: one a round.
            _, own = np.unique(np.minimum(bucket, other) << 16 | prints, return_index=True)
            here = self.table[bucket[own]] == prints[own, None]
            at = np.where(here.any(axis=1), bucket[own], other[own])
            found = self.table[at] == prints[own, None]
            if not found.any(axis=1).all():
                raise ValueError("a key was never inserted")
            self.table[at, found.argmax(axis=1)] = 0
            stay = np.ones(len(prints), bool)
            stay[own] = False
            prints, bucket, other = prints[stay], bucket[stay], other[stay]
