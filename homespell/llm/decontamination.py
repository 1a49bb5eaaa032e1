"""Benchmark passages in documents, by SimHash of item-sized windows.

Every benchmark item is compared with the windows of a document that have as many words as the
item (the whole document where it is shorter), one word apart. Features are five-word shingles, and
a shingle weighs as many units as it has distinct words, so that repetition counts little. A window
and an item become candidates when their 128-bit SimHash fingerprints differ in at most ``RADIUS``
bits; ``RADIUS + 1`` blocks of bits are indexed, of which two such fingerprints share at least one
(pigeonhole), so the index misses none. Candidates are verified by the exact weighted similarity:
common weight over united weight of the two shingle multisets.

Words are lower-cased and ASCII punctuation parts them, so that quotes or a full stop next to
a passage do not hide it. Windows without a shingle of an item have similarity 0 with it and are left out beforehand.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm.text import SHINGLE, map_batches, mix, shingles, texts, without_rows, word_hashes

BITS = 128
#: Least weighted similarity of a match, in hundredths.
THRESHOLD = 75
#: Chance that a pair at the threshold lies beyond the radius.
MISS = 1e-6
#: Words of benchmark items that one pass over the documents holds; a larger benchmark takes several.
BLOCK_WORDS = 2_000_000
#: Windows that are fingerprinted at a time, and shingles that these may span.
WINDOWS, SPANNED = 4096, 8192
_FILTER_BITS = 20
_SCHEMA = "doc_id long, row_key long, item_id long, start_word long, n_words long, similarity double"


def radius(bits: int = BITS, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """Bits that fingerprints at the threshold differ in, exceeded with chance ``miss`` at most.

    Multisets of equal weight and weighted similarity s have a cosine of about 2s / (1 + s), and one
    bit differs with probability angle / pi.
    """
    p = math.acos(2 * threshold / (1 + threshold)) / math.pi
    tail = 1.0
    for r in range(bits + 1):
        tail -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if tail <= miss:
            return r
    return bits


RADIUS = radius()
#: Bit ranges of the index: RADIUS + 1 blocks of nearly equal size.
BLOCKS = np.linspace(0, BITS, RADIUS + 2).astype(int)


_PLAIN = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    return text.decode().lower().encode().translate(_PLAIN).split() if text else []


def weights(hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each shingle."""
    size = min(SHINGLE, len(hashes))
    if not size:
        return np.empty(0, np.int64)
    count = len(hashes) - size + 1
    words = np.sort(np.stack([hashes[k:k + count] for k in range(size)], axis=1), axis=1)
    return 1 + (words[:, 1:] != words[:, :-1]).sum(axis=1)


def _votes(elements: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight (at most ``SHINGLE``) with the sign of each bit of each shingle's 128-bit hash."""
    wide = np.stack([mix(elements), mix(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(elements), 16), axis=1).astype(np.int8)
    return (2 * bits - 1) * weight[:, None].astype(np.int8)


def _batches(starts: np.ndarray) -> Iterator[np.ndarray]:
    """Ascending ``starts`` in runs of at most ``WINDOWS``, whose first and last lie less than ``SPANNED`` apart."""
    first = 0
    while first < len(starts):
        last = min(first + WINDOWS, int(np.searchsorted(starts, starts[first] + SPANNED)))
        yield starts[first:last]
        first = last


def fingerprints(elements: np.ndarray, weight: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Bits of the SimHash of the windows of ``length`` shingles at ``starts``."""
    total = np.zeros((len(elements) + 1, BITS), np.int64)
    np.cumsum(_votes(elements, weight), axis=0, out=total[1:])
    return total[starts + length] > total[starts]


def block_values(bits: np.ndarray) -> np.ndarray:
    """Number that each block of bits spells."""
    columns = []
    for low, high in zip(BLOCKS[:-1], BLOCKS[1:]):
        columns.append(bits[:, low:high] @ (1 << np.arange(high - low)))
    return np.stack(columns, axis=1)


def similarity(left: np.ndarray, left_weight: np.ndarray, right: np.ndarray, right_weight: np.ndarray) -> float:
    """Common over united weight of two shingle multisets."""
    keys, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a = np.bincount(at[:len(left)], left_weight, len(keys))
    b = np.bincount(at[len(left):], right_weight, len(keys))
    united = np.maximum(a, b).sum()
    return float(np.minimum(a, b).sum() / united) if united else 0.0


class ItemIndex:
    """Items grouped by their number of words, with their fingerprints in blocks."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        hashes = word_hashes()
        self.ids, self.elements, self.weights, self.sizes = [], [], [], []
        for item_id, text in items:
            words = hashes.of(plain_words(text))
            if len(words):
                self.ids.append(item_id)
                self.elements.append(shingles(words))
                self.weights.append(weights(words))
                self.sizes.append(len(words))
        #: Shingle to the items that hold it, as sorted pairs.
        owners = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.elements]) if self.ids else np.empty(0, np.int64)
        keys = np.concatenate(self.elements) if self.ids else np.empty(0, np.uint64)
        order = np.lexsort((owners, keys))
        self.keys, self.owners = keys[order], owners[order]
        self.present = np.zeros(1 << _FILTER_BITS, bool)
        self.present[self.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.bits = np.concatenate([fingerprints(e, w, np.zeros(1, int), len(e)) for e, w in zip(self.elements, self.weights)]) if self.ids else np.empty((0, BITS), bool)
        self.blocks = block_values(self.bits) if self.ids else np.empty((0, RADIUS + 1), int)
        self.of_size = {size: np.flatnonzero(np.array(self.sizes) == size) for size in set(self.sizes)}

    def hits(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that items hold, and the items, a row for each pair."""
        at = np.flatnonzero(self.present[elements >> np.uint64(64 - _FILTER_BITS)])
        low, high = (np.searchsorted(self.keys, elements[at], side) for side in ("left", "right"))
        at, low, high = at[high > low], low[high > low], high[high > low]
        count = high - low
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(at, count), self.owners[np.repeat(low, count) + within]

    def candidates(self, bits: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(window, item) pairs within the radius, found through equal blocks."""
        items = self.of_size[size]
        blocks = block_values(bits)
        near = np.zeros((len(bits), len(items)), bool)
        for k in range(blocks.shape[1]):
            own = self.blocks[items, k]
            order = np.argsort(own, kind="stable")
            low, high = (np.searchsorted(own[order], blocks[:, k], side) for side in ("left", "right"))
            count = high - low
            window = np.repeat(np.arange(len(bits)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            near[window, order[np.repeat(low, count) + within]] = True
        window, item = np.nonzero(near)
        close = (bits[window] != self.bits[items[item]]).sum(axis=1) <= RADIUS
        return zip(window[close].tolist(), items[item[close]].tolist())

    def matches(self, text: bytes | None, threshold: int) -> list[tuple[int | None, int, int, float]]:
        """Best window of each item that reaches the threshold; of equals the first."""
        words = word_hashes().of(plain_words(text))
        n = len(words)
        if not n or not self.ids:
            return []
        # Items of fewer words than a shingle are one short shingle each: runs of that many words.
        found: dict[int, tuple[float, int, int]] = {}
        for group in sorted({min(size, SHINGLE) for size in self.sizes}):
            elements = shingles(words, SHINGLE) if group == SHINGLE or n <= group else self._short_runs(words, group)
            position, item = self.hits(elements)
            sizes = np.array(self.sizes)[item] if len(item) else np.empty(0, int)
            fits = np.minimum(sizes, SHINGLE) == group
            position, sizes = position[fits], sizes[fits]
            for size in np.unique(sizes):
                self._windows(words, elements, position[sizes == size], int(size), group, threshold, found)
        return [(self.ids[i], start, length, s) for i, (s, start, length) in sorted(found.items())]

    @staticmethod
    def _short_runs(words: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([shingles(words[k:k + size]) for k in range(len(words) - size + 1)])

    def _windows(self, words, elements, position, size, group, threshold, found) -> None:
        n = len(words)
        length = min(size, n)
        span = max(1, length - group + 1)
        # A window at s holds the shingles s .. s + span - 1.
        starts = np.unique(np.clip((position[:, None] - np.arange(span)).ravel(), 0, len(elements) - span))
        low, high = int(starts[0]), int(starts[-1]) + span
        own = elements[low:high]
        weight = weights(words[low:high + group - 1]) if n >= group and group == SHINGLE else np.array(
            [len(np.unique(words[k:k + min(group, n)])) for k in range(low, high)])
        for some in _batches(starts):
            near, far = int(some[0]) - low, int(some[-1]) - low + span
            bits = fingerprints(own[near:far], weight[near:far], some - int(some[0]), span)
            for window, item in self.candidates(bits, size):
                start = int(some[window])
                s = similarity(elements[start:start + span], weight[start - low:start - low + span], self.elements[item], self.weights[item])
                if 100 * s >= threshold - 1e-9 and (item not in found or s > found[item][0]):
                    found[item] = (s, start, length)


def _blocks_of_items(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.size(F.split(F.col("text"), r"[\t-\r ]+")).cast("long"))).first()[0] or 0
    parts = -(-size // BLOCK_WORDS)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()
        yield sorted(((row.item_id, row.text.encode()) for row in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def passages(docs: DataFrame, benchmark: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, row_key, item_id, start_word, n_words, similarity``: the best window of each item
    in each document that reaches ``threshold`` hundredths.

    Needs doc_id and text of ``docs``, item_id and text of ``benchmark``; ``row_key`` is a hash of the
    text that tells rows of one doc_id apart. Null, empty and wordless texts and items match nothing; repeated
    items count once; equal items of different ids are each reported. Items of fewer than five words are
    one shingle, looked for in windows of as many words.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"))
    found = None
    for items in _blocks_of_items(benchmark):
        index = ItemIndex(items)

        def search(batch: pa.RecordBatch, index: ItemIndex = index) -> pa.RecordBatch:
            at, out = [], []
            for row, own in enumerate(texts(batch)):
                for match in index.matches(own, threshold):
                    at.append(row)
                    out.append(match)
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("row_key").take(rows), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["doc_id", "row_key", "item_id", "start_word", "n_words", "similarity"])

        part = map_batches(rows, search, _SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item; all columns stay, repeated rows too."""
    return without_rows(docs, passages(docs, benchmark))
