"""Words, hashes and Arrow plumbing that the text operators share.

Words are maximal runs of characters outside ASCII white space (space, tab, line feed, vertical
tab, form feed, carriage return). They are handled as UTF-8 bytes: ``bytes.split`` splits on
exactly those six characters and ``bytes.lower`` lowers A-Z alone.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.session import ship

#: Entries a worker's word cache holds before it starts afresh; a bound on memory only.
CACHE_WORDS = 500_000
#: Words of a shingle.
SHINGLE = 5

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_SHORT = 0xD6E8FEB86659FD93


class WordHashes(dict):
    """64-bit hash of each word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@functools.lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    """One cache for the life of a worker process."""
    return WordHashes()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    folded = hashes[:count].copy()
    for shift in range(1, size):
        folded = folded * _FOLD + hashes[shift:shift + count]
    return mix(folded)


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingle hashes in text order. A shorter text is one shingle; no words give none."""
    n = len(hashes)
    if 0 < n < size:
        return mix(runs(hashes, n) + np.uint64(_SHORT * n % 2**64))
    return runs(hashes, size)


def lowered_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The column's values as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """A row-wise step over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)

    return map_partitions(df, run, schema)


def map_partitions(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """A step that sees the batches of a partition one after another."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return what a task has freed to the system: the worker lives on, next to those of later stages and the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def ragged(arrays: list[np.ndarray], dtype: type) -> pa.ListArray:
    """One list per row from numpy arrays, without Python objects per value."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).astype(dtype, copy=False) if arrays else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def lowest(df: DataFrame, rows: int, key: Column, *ties: str) -> DataFrame:
    """The ``rows`` rows of least ``key``, a 64-bit hash, in that order.

    A bound on the hash leaves little more than these rows before they are sorted, so tasks do not each send as
    many to the driver. ``df`` is read three times and should be a saved table.
    """
    total = df.count()
    if total > rows:
        share = min(1.0, (rows + 10 * rows**0.5 + 10) / total)
        near = df.where(key <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
        # Keys that many rows share can leave too few; then all rows are sorted.
        if near.count() >= rows:
            df = near
    return df.orderBy(key, *ties).limit(rows)


def fold_remainder(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds if isinstance(doc_id, str) else \
        F.crc32(doc_id.cast("string").cast("binary")) % folds


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text are not those of a row in ``gone`` (doc_id, and row_key, the hash of the text).

    All columns stay, whatever their names; rows without doc_id or text are compared too.
    """
    taken = {name.lower() for name in docs.columns}
    fresh = lambda name: name if name not in taken else fresh(name + "_")
    doc_id, row_key = fresh("gone_id"), fresh("gone_key")
    listed = gone.select(F.col("doc_id").alias(doc_id), F.col("row_key").alias(row_key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row_key))
    return docs.join(listed, same, "left_anti")
