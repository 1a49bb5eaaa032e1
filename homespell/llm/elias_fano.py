"""Monotone sequences in Elias-Fano form, searched by numpy over memory-mapped arrays.

Of each value the low bits are stored packed, and the high parts as a bit vector in which value ``i`` of
high part ``h`` sets bit ``h + i``. The zeros part the values into buckets of one high part, so the bucket of a
value is found by selecting two zeros, and a successor search looks at that bucket alone.
"""

from __future__ import annotations

import numpy as np

_POPCOUNT = np.array([bin(k).count("1") for k in range(256)], np.uint8)
#: Position of the r-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _rank, _bit in enumerate(k for k in range(8) if _byte >> k & 1):
        _SELECT[_byte, _rank] = _bit


class Writer:
    """Collects arrays of one file: 64-bit words after a header of their lengths."""

    def __init__(self) -> None:
        self.arrays: list[np.ndarray] = []

    def put(self, values: np.ndarray) -> None:
        self.arrays.append(np.ascontiguousarray(values))

    def put_sequence(self, values: np.ndarray) -> None:
        """``values``: sorted unsigned 64-bit."""
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        length = (int(high[-1]) if n else 0) + n + 1
        bits = np.zeros(-(-length // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POPCOUNT[packed].reshape(-1, 8).sum(axis=1, dtype=np.int64))])
        self.put(np.array([n, low_bits, length], np.int64))
        self.put(packed)
        self.put(ones.astype(np.int64)[:-1] if len(ones) > 1 else ones.astype(np.int64))
        self.put(_pack(values & np.uint64((1 << low_bits) - 1), low_bits))

    def put_packed(self, values: np.ndarray) -> None:
        """``values``: unsigned, each in as many bits as the largest needs."""
        width = int(values.max(initial=0)).bit_length()
        self.put(np.array([width], np.int64))
        self.put(_pack(values.astype(np.uint64), width))

    def chunks(self) -> list[bytes]:
        head = np.array([len(self.arrays), *(x.nbytes for x in self.arrays)], "<i8").tobytes()
        padded = [x.tobytes() + b"\0" * (-x.nbytes % 8) for x in self.arrays]
        return [head, *padded]


class Reader:
    """Gives the arrays of a file back in the order in which they were put."""

    def __init__(self, data: np.ndarray):
        count = int(data[:8].view("<i8")[0])
        self.sizes = data[8:8 + 8 * count].view("<i8").tolist()
        self.data, self.at, self.next = data, 8 + 8 * count, 0

    def get(self, dtype: str) -> np.ndarray:
        size = self.sizes[self.next]
        out = self.data[self.at:self.at + size].view(dtype)
        self.at += size + -size % 8
        self.next += 1
        return out

    def get_packed(self) -> "Packed":
        return Packed(int(self.get("<i8")[0]), self.get("<u8"))

    def get_sequence(self) -> "Sequence":
        shape = self.get("<i8")
        return Sequence(*shape.tolist(), self.get("u1"), self.get("<i8"), self.get("<u8"))


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width and len(values):
        start = np.arange(len(values), dtype=np.int64) * width
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        np.bitwise_or.at(words, word, values << shift)
        spill = np.flatnonzero((start & 63) + width > 64)
        np.bitwise_or.at(words, word[spill] + 1, values[spill] >> (np.uint64(64) - shift[spill]))
    return words


class Packed:
    """Values of ``width`` bits each."""

    def __init__(self, width: int, words: np.ndarray):
        self.width, self.words = width, words

    def get(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        start = at.astype(np.int64) * self.width
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        value = self.words[word] >> shift
        # A shift by 64 is undefined, so the next word is moved in two steps.
        value |= (self.words[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return value & np.uint64((1 << self.width) - 1)


class Sequence:
    def __init__(self, n: int, low_bits: int, length: int, high: np.ndarray, ones: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.length = n, low_bits, length
        self.high, self.ones, self.packed = high, ones, Packed(low_bits, low)
        #: Zeros before each 64-bit word.
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        self.top = length - n - 1

    def _low(self, at: np.ndarray) -> np.ndarray:
        return self.packed.get(at)

    def _select(self, rank: np.ndarray, before: np.ndarray, flip: int) -> np.ndarray:
        """Position of the set (or, flipped, unset) bit of each rank."""
        word = np.searchsorted(before, rank, side="right") - 1
        left = rank - before[word]
        at = word * 8
        out = np.empty(len(rank), np.int64)
        todo = np.arange(len(rank))
        for _ in range(8):
            byte = self.high[at[todo]] ^ np.uint8(flip)
            inside = _POPCOUNT[byte]
            found = left[todo] < inside
            hit = todo[found]
            out[hit] = at[hit] * 8 + _SELECT[byte[found], left[hit]]
            todo = todo[~found]
            if not len(todo):
                break
            left[todo] -= inside[~found]
            at[todo] += 1
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        high = self._select(at.astype(np.int64), self.ones, 0) - at
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where the sequence does not hold it: the successor is looked for in
        the bucket of the value's high part."""
        out = np.full(len(values), -1, np.int64)
        high = values >> np.uint64(self.low_bits)
        rows = np.flatnonzero(high <= np.uint64(self.top)) if self.n else np.empty(0, np.int64)
        if not len(rows):
            return out
        high = high[rows].astype(np.int64)
        # Bucket h lies between zero h - 1 and zero h.
        start = np.zeros(len(rows), np.int64)
        inner = np.flatnonzero(high > 0)
        start[inner] = self._select(high[inner] - 1, self.zeros, 255) + 1 - high[inner]
        end = self._select(high, self.zeros, 255) - high
        wanted = values[rows] & np.uint64((1 << self.low_bits) - 1)
        # The low parts of a bucket are sorted: halve what is left of it.
        top, live = end.copy(), np.flatnonzero(start < end)
        while len(live):
            middle = (start[live] + top[live]) >> 1
            below = self._low(middle) < wanted[live]
            start[live] = np.where(below, middle + 1, start[live])
            top[live] = np.where(below, top[live], middle)
            live = live[start[live] < top[live]]
        inside = np.flatnonzero(start < end)
        hit = inside[self._low(start[inside]) == wanted[inside]]
        out[rows[hit]] = start[hit]
        return out
