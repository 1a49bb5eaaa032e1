"""Packing documents into sequences by patterns of lengths.

Documents longer than a sequence are cut into full pieces and a rest. What is left to pack is a
histogram of lengths, and its size is bounded by the sequence length, not by the corpus. Patterns
are multisets of two to four lengths that fill a sequence exactly (and the single full length). How often to repeat
each pattern is a non-negative least-squares fit of the patterns to the histogram; the repeats are
rounded down and never use a length more often than it occurs. The residual is packed best fit
first: the longest length left, then again and again the longest that still fits, repeated as often as the
counts allow.

A document gets its place from its rank among those of its length. Each task numbers its own pieces
per length, and a sum over tasks per length gives the rest of the rank, so a length that a third of all pieces
share needs no single task. The plan, in contrast, is small: intervals of ranks per length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import map_batches, map_partitions
from homespell.llm.token_cache import encoder

SEQUENCE = 2048
#: Steps of the least-squares fit.
STEPS = 150
#: Splits tried of what a pattern's longest length leaves: parts at these shares of the rest.
SHARES = tuple(k / 16 for k in range(1, 9))
END_ID = 0


def patterns(length: int = SEQUENCE, present: np.ndarray | None = None) -> np.ndarray:
    """Rows of four lengths, longest first, filled up with 0, that sum to ``length``.

    All pairs are listed. Triples and quadruples split the rest of their first length, and the
    rest of that, at ``SHARES``. With ``present`` (lengths that occur), only patterns of those are kept.
    """
    rows = [np.array([[length, 0, 0, 0]])]
    first = np.arange(1, length)
    rows.append(np.stack([first, length - first, 0 * first, 0 * first], axis=1))
    triples = []
    for share in SHARES:
        second = np.maximum(1, np.rint((length - first) * share).astype(int))
        triples.append(np.stack([first, second, length - first - second, 0 * first], axis=1))
    triples = np.concatenate(triples)
    rows.append(triples)
    rest = np.concatenate([triples] * 4)
    share = np.repeat([0.125, 0.25, 0.375, 0.5], len(triples))
    fourth = np.rint(rest[:, 2] * share).astype(int)
    rows.append(np.stack([rest[:, 0], rest[:, 1], rest[:, 2] - fourth, fourth], axis=1))
    found = np.concatenate(rows)
    found = found[(found[:, :2] >= 0).all(axis=1) & (found[:, 2] >= 0)]
    found = np.unique(-np.sort(-found, axis=1), axis=0)
    if present is not None:
        known = np.concatenate([[True], present[1:]])
        found = found[known[found].all(axis=1)]
    return found


def fit_repeats(shapes: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeats that bring the patterns' lengths closest to the histogram.

    Accelerated projected gradient on the squared differences, each length weighted by one over
    its count, so that rare lengths are matched as well as common ones.
    """
    if not len(shapes):
        return np.zeros(0)
    weight = np.where(histogram > 0, 1.0 / np.maximum(histogram, 1), 0.0)
    weight[0] = 0.0
    target = histogram.astype(float)

    def used(repeats: np.ndarray) -> np.ndarray:
        return np.bincount(shapes.ravel(), np.repeat(repeats, shapes.shape[1]), len(histogram))

    # A diagonal bound of the curvature gives each pattern its own step.
    touching = np.bincount(shapes.ravel(), minlength=len(histogram)).astype(float)
    reach = (weight * touching)[shapes].sum(axis=1) * shapes.shape[1]
    step = 1.0 / np.maximum(reach, 1e-12)
    repeats = ahead = np.zeros(len(shapes))
    momentum = 1.0
    for _ in range(steps):
        slope = (weight * (used(ahead) - target))[shapes].sum(axis=1)
        following = np.maximum(0.0, ahead - step * slope)
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + (momentum - 1) / grown * (following - repeats)
        repeats, momentum = following, grown
    return repeats


def plan(histogram: np.ndarray, length: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeats that use up the histogram (count of each length, by index)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def take(shape: tuple[int, ...], wanted: int) -> None:
        parts, times = np.unique(shape, return_counts=True)
        repeats = int(min(wanted, (left[parts] // times).min()))
        if repeats > 0:
            left[parts] -= repeats * times
            out.append((shape, repeats))

    shapes = patterns(length, left > 0)
    repeats = np.floor(fit_repeats(shapes, left) + 1e-6).astype(np.int64)
    for at in np.flatnonzero(repeats):
        take(tuple(int(x) for x in shapes[at] if x), int(repeats[at]))

    while left.any():
        room, shape = length, []
        budget = left.copy()
        while room:
            fitting = np.flatnonzero(budget[:room + 1])
            if not len(fitting):
                break
            longest = int(fitting[-1])
            shape.append(longest)
            budget[longest] -= 1
            room -= longest
        take(tuple(shape), int(left.max()))
    return out


class Places:
    """Sequence and offset of each rank of each length, as intervals of ranks."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], length: int):
        used = np.zeros(length + 1, np.int64)
        rows, sequence = [], 0
        for shape, repeats in planned:
            offset = 0
            for part in shape:
                rows.append((part, int(used[part]), sequence, offset))
                used[part] += repeats
                offset += part
            sequence += repeats
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.length, self.low, self.sequence, self.offset = table.T
        self.first = np.searchsorted(self.length, np.arange(length + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for own in np.unique(length):
            rows = np.flatnonzero(length == own)
            some = slice(self.first[own], self.first[own + 1])
            at = self.first[own] + np.searchsorted(self.low[some], rank[rows], side="right") - 1
            sequence[rows] = self.sequence[at] + rank[rows] - self.low[at]
            offset[rows] = self.offset[at]
        return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """Pieces of each row's ids with the end id: ``doc_id, piece, start, length, ids_crc32``, and
    the task and the number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(tokenizer, False)
        task = TaskContext.get().partitionId()
        seen = np.zeros(length + 1, np.int64)
        for batch in batches:
            ids, offsets = units.ids(batch.column("text").to_pylist())
            sizes = offsets[1:] - offsets[:-1] + 1
            count = -(-sizes // length)
            row = np.repeat(np.arange(batch.num_rows), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            own = np.minimum(sizes[row] - start, length)
            crc = np.empty(len(row), np.int64)
            for at, (r, low, size) in enumerate(zip(row.tolist(), start.tolist(), own.tolist())):
                end = offsets[r] + low + size
                whole = ids[offsets[r] + low:min(end, offsets[r + 1])].astype("<u4").tobytes()
                crc[at] = zlib.crc32(whole if end <= offsets[r + 1] else whole + END_ID.to_bytes(4, "little"))
            order = np.argsort(own, kind="stable")
            ranked = own[order]
            fresh = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.empty(0, bool)
            group = np.flatnonzero(fresh)
            number = np.empty(len(own), np.int64)
            number[order] = np.arange(len(own)) - np.repeat(group, np.diff(np.r_[group, len(own)])) + seen[ranked]
            seen += np.bincount(own, minlength=length + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(own), pa.array(crc),
                 pa.array(np.full(len(row), task, np.int64)), pa.array(number)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_partitions(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, task long, number long")


def pack(docs: DataFrame, tokenizer: str, length: int = SEQUENCE) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of each row.

    Needs doc_id and text. A null or empty text is its end id alone; rows without doc_id and repeated rows are
    packed like all others. An empty table gives no rows.
    """
    cut = store.save(pieces(docs, tokenizer, length), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = store.save(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "lengths")
    histogram = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row.length] = row.n
    places = Places(plan(histogram, length), length)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column("length").to_numpy()
        sequence, offset = places.find(own, batch.column("number").to_numpy() + batch.column("before").to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(counts.select("length", "task", "before"), ["length", "task"])
    return map_batches(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number", "before"), place,
                       "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
