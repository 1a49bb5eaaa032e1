"""Line dedup that can be taken back: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends and in lower case; keys of at least ``LEAST_CHARS``
code points count. The index has two tables. The holders, a row for each document and key it holds, say what a document
brought in, so that it can be taken out again. The shards, files in the shared folder, hold each key's
exact number of holder rows and its smallest and largest document, next to a cuckoo filter of these keys.

An insertion combines its keys before they move and sends one row a key to the key's shard, however many
documents hold it. There the filter tells keys that are certainly new, which are added without a look at the exact
table; the others are looked up and counted up. A removal counts down: of the keys that the removed documents held,
what is left among the other holders replaces the exact row, and a key that nobody holds leaves table and filter. So
inserting and removing in any order gives the index of the documents that remain.

Shards are ranges of the keys' hashes and split when they outgrow ``KEYS_PER_SHARD``. Every change writes a new
generation of files under names of their attempts, so a lost or repeated task harms nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.cuckoo import CuckooFilter
from homespell.llm.elias_fano import Reader, Writer
from homespell.llm.text import map_batches, map_partitions, texts

LEAST_CHARS = 10
KEYS_PER_SHARD = 250_000
#: Tasks that shards are dealt to at most.
MOST_TASKS = 16_384
_WHITE = b" \t\n\x0b\x0c\r"
_KEY = ["key_hi", "key_lo"]
_SHARD_BITS = 30


def line_keys(text: bytes | None) -> list[tuple[int, int] | None]:
    """128-bit key of each line as two signed halves; None for lines that are too short to count."""
    out = []
    for line in (text or b"").split(b"\n"):
        key = line.strip(_WHITE).lower()
        if len(key) < LEAST_CHARS or (not key.isascii() and len(key.decode()) < LEAST_CHARS):
            out.append(None)
        else:
            value = xxhash.xxh3_128_digest(key)
            out.append((int.from_bytes(value[:8], "big", signed=True), int.from_bytes(value[8:], "big", signed=True)))
    return out


def _held(batch: pa.RecordBatch) -> pa.RecordBatch:
    high, low, ids = [], [], []
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
        for key in {key for key in line_keys(text) if key}:
            high.append(key[0])
            low.append(key[1])
            ids.append(doc_id)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (high, low, ids)], names=["key_hi", "key_lo", "doc_id"])


def holders(docs: DataFrame) -> DataFrame:
    """``key_hi, key_lo, doc_id`` of each row of ``docs`` and distinct key in it; rows without doc_id hold nothing."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, _held, "key_hi long, key_lo long, doc_id long")


def _shard_of(high: Column, shards: int) -> Column:
    """Shards are ranges of the key's upper half, so those of a finer dealing lie within one of a coarser."""
    top = F.shiftrightunsigned(high, 64 - _SHARD_BITS)
    return F.shiftright(top * F.lit(shards), _SHARD_BITS).cast("int")


def _split(high: np.ndarray, shards: int) -> np.ndarray:
    return ((high.view(np.uint64) >> np.uint64(64 - _SHARD_BITS)) * np.uint64(shards) >> np.uint64(_SHARD_BITS)).astype(np.int64)


class Shard:
    """Exact rows in the order of their keys, and the filter of these keys."""

    def __init__(self, columns: list[np.ndarray], filter_: CuckooFilter):
        self.columns, self.filter = columns, filter_

    @classmethod
    def empty(cls) -> Shard:
        return cls([np.empty(0, np.int64) for _ in range(5)], CuckooFilter.of(np.empty(0, np.uint64)))

    @classmethod
    def open(cls, data: np.ndarray) -> Shard:
        reader = Reader(data)
        columns = [reader.get("<i8") for _ in range(5)]
        return cls(columns, CuckooFilter(np.array(reader.get("<u2")).reshape(-1, 4)))

    def chunks(self) -> list[bytes]:
        writer = Writer()
        for column in self.columns:
            writer.put(column.astype("<i8"))
        writer.put(self.filter.table.astype("<u2"))
        return writer.chunks()

    def part(self, number: int, shards: int) -> Shard:
        """The rows of one shard of a finer dealing."""
        own = _split(np.array(self.columns[0]), shards) == number
        if own.all():
            return self
        columns = [np.array(column)[own] for column in self.columns]
        return Shard(columns, CuckooFilter.of(columns[1].view(np.uint64)))

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for keys that are not here; the exact table is read only where the filter says so."""
        out = np.full(len(high), -1, np.int64)
        live = np.flatnonzero(self.filter.holds(low.view(np.uint64)))
        at = np.searchsorted(self.columns[0], high[live])
        while len(live):
            inside = at < len(self.columns[0])
            live, at = live[inside], at[inside]
            same = self.columns[0][at] == high[live]
            live, at = live[same], at[same]
            hit = self.columns[1][at] == low[live]
            out[live[hit]] = at[hit]
            live, at = live[~hit], at[~hit] + 1
        return out

    def _with(self, columns: list[np.ndarray], added: np.ndarray) -> Shard:
        order = np.lexsort((columns[1], columns[0]))
        columns = [column[order] for column in columns]
        if not self.filter.room_for(len(added)) or not self.filter.insert(added):
            return Shard(columns, CuckooFilter.of(columns[1].view(np.uint64)))
        return Shard(columns, self.filter)

    def counted_up(self, rows: list[np.ndarray]) -> Shard:
        """``rows``: keys, once each, with the holder rows to add and their smallest and largest document."""
        at = self.find(rows[0], rows[1])
        columns = [np.array(column) for column in self.columns]
        known, new = at >= 0, at < 0
        columns[2][at[known]] += rows[2][known]
        np.minimum.at(columns[3], at[known], rows[3][known])
        np.maximum.at(columns[4], at[known], rows[4][known])
        return self._with([np.concatenate([c, r[new]]) for c, r in zip(columns, rows)], rows[1][new].view(np.uint64))

    def counted_down(self, rows: list[np.ndarray]) -> Shard:
        """``rows``: keys that are here with what is left of them; those with no holder row go."""
        at = self.find(rows[0], rows[1])
        if (at < 0).any():
            raise ValueError("a removed key is not in the index")
        columns = [np.array(column) for column in self.columns]
        for column, own in zip(columns[2:], rows[2:]):
            column[at] = own
        stay = columns[2] > 0
        self.filter.remove(columns[1][~stay].view(np.uint64))
        return Shard([column[stay] for column in columns], self.filter)


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """A task for each shard, or for as many shards as there are beyond ``MOST_TASKS``."""
    tasks = min(shards, MOST_TASKS)
    return rows.repartitionById(tasks, F.col("shard") % tasks)


class LineIndex:
    """Which documents hold which lines, changed by whole documents."""

    def __init__(self, spark: SparkSession, keys_per_shard: int = KEYS_PER_SHARD):
        self.spark, self.keys_per_shard = spark, keys_per_shard
        self.shards = 1
        self.folder: str | None = None
        self.files: DataFrame | None = None
        self.held: list[DataFrame] = []

    def insert(self, docs: DataFrame) -> None:
        """Add the rows of ``docs`` (doc_id, text); rows of a doc_id that is here already add to it."""
        self.insert_holders(store.save(holders(docs), "holders"))

    def insert_holders(self, held: DataFrame) -> None:
        """Add documents by their ``holders``, a saved table."""
        rows = held.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        self.held.append(held)
        self._change(rows, held.count(), Shard.counted_up)

    def remove(self, doc_ids: DataFrame) -> None:
        """Take out all rows of the documents in ``doc_ids`` (doc_id); ids that are not here are passed over."""
        if not self.held:
            return
        ids = doc_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        every = self._holders()
        gone = store.save(every.join(ids, "doc_id", "left_semi").select(*_KEY).distinct(), "gone")
        left = store.save(every.join(ids, "doc_id", "left_anti").select(*_KEY, "doc_id"), "holders")
        after = (left.join(gone, _KEY, "left_semi").groupBy(*_KEY)
                 .agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")))
        rows = gone.join(after, _KEY, "left").select(*_KEY, *[F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("refs", "least", "most")])
        self._change(rows, 0, Shard.counted_down)
        store.discard(gone, *self.held)
        self.held = [left]

    def _holders(self) -> DataFrame:
        every = self.held[0]
        for more in self.held[1:]:
            every = every.unionByName(more)
        return every

    def keys(self) -> int:
        return 0 if self.files is None else self.files.agg(F.sum("keys")).first()[0] or 0

    def _change(self, rows: DataFrame, most_new: int, change) -> None:
        """Write the next generation of shards; ``rows``: key, refs, least and most."""
        wanted, finer = self.keys() + most_new, 1
        while wanted > self.keys_per_shard * self.shards * finer:
            finer *= 2
        shards, before, old = self.shards * finer, self.folder, self.files
        folder = store.fresh_path(self.spark, "lines")
        nothing = F.lit(None).cast("long")
        dealt = rows.select(_shard_of(F.col("key_hi"), shards).alias("shard"), F.lit(None).cast("string").alias("file"), *_KEY, "refs", "least", "most")
        if old is not None:
            children = F.explode(F.sequence(F.col("shard") * finer, F.col("shard") * finer + finer - 1))
            dealt = dealt.unionByName(old.select(children.alias("shard"), "file", *[nothing.alias(n) for n in (*_KEY, "refs", "least", "most")]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, opened, waiting = None, Shard.empty(), []

            def close() -> pa.RecordBatch:
                columns = [np.concatenate(own) for own in zip(*waiting)] if waiting else None
                made = opened if columns is None else change(opened, columns)
                name = f"shard-{current:08d}-{TaskContext.get().taskAttemptId()}"
                store.put_file(folder, name, TaskContext.get().taskAttemptId(), made.chunks())
                return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int32()), "file": [name], "keys": pa.array([len(made.columns[0])], pa.int64())})

            for batch in batches:
                number = batch.column("shard").to_numpy()
                for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(number[1:] != number[:-1]) + 1):
                    if not len(cut):
                        continue
                    if number[cut[0]] != current:
                        if current is not None:
                            yield close()
                        current, opened, waiting = int(number[cut[0]]), Shard.empty(), []
                    own = batch.slice(int(cut[0]), len(cut))
                    # A shard's file stands before its rows.
                    if (file := own.column("file")[0].as_py()) is not None:
                        opened = Shard.open(store.map_file(before, file)).part(current, shards)
                        own = own.slice(1)
                    if own.num_rows:
                        waiting.append([own.column(name).to_numpy() for name in (*_KEY, "refs", "least", "most")])
            if current is not None:
                yield close()

        spread = _dealt(dealt, shards).sortWithinPartitions("shard", F.col("file").desc_nulls_last())
        self.files = store.save(map_partitions(spread, run, "shard int, file string, keys long"), "line-shards")
        self.folder, self.shards = folder, shards
        if before is not None:
            store.remove(self.spark, before)
            store.discard(old)

    def repeated(self) -> DataFrame:
        """``key_hi, key_lo, keeper`` of the keys that at least two documents hold, with the smallest of these."""
        if self.files is None:
            return self.spark.createDataFrame([], "key_hi long, key_lo long, keeper long")
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.column("file").to_pylist():
                    columns = Shard.open(store.map_file(folder, file)).columns
                    several = columns[3] < columns[4]
                    yield pa.RecordBatch.from_arrays([pa.array(columns[k][several]) for k in (0, 1, 3)], names=["key_hi", "key_lo", "keeper"])

        found = map_partitions(_dealt(self.files, self.shards).select("file"), run, "key_hi long, key_lo long, keeper long")
        # Written, so that a join goes by its size and not by that of the list of files.
        return store.save(found, "repeated")

    def keep(self, docs: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """``doc_id, text, n_lines, n_dropped`` of each row of ``docs``, which are in the index.

        A line goes where at least two documents hold its key and this is not the smallest of them. ``held``: the
        ``holders`` of ``docs`` where they are at hand.
        """
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        held = holders(docs) if held is None else held
        dropped = (held.join(self.repeated(), _KEY).where("doc_id <> keeper").select("doc_id", *_KEY).distinct()
                   .groupBy("doc_id").agg(F.collect_list(F.struct(*_KEY)).alias("dropped")))
        return map_batches(rows.join(dropped, "doc_id", "left"), _without, "doc_id long, text string, n_lines long, n_dropped long")

    def discard(self) -> None:
        """Delete the index; no result of it may be read afterwards."""
        store.discard(*self.held, *([self.files] if self.files is not None else []))
        if self.folder is not None:
            store.remove(self.spark, self.folder)
        self.held, self.files, self.folder, self.shards = [], None, None, 1


def _without(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("dropped")
    values = lists.flatten()
    pairs = list(zip(values.field(0).to_pylist(), values.field(1).to_pylist()))
    sizes = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
    kept, n_lines, n_dropped = [], [], []
    for row, text in enumerate(texts(batch)):
        lines = (text or b"").split(b"\n")
        gone = set(pairs[sizes[row]:sizes[row + 1]])
        stay = [line for line, key in zip(lines, line_keys(text)) if key not in gone] if gone else lines
        kept.append(b"\n".join(stay))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(stay))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                      names=["doc_id", "text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, increments: int = 2) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of each row of ``docs`` (doc_id, text) without lines that smaller documents hold.

    All documents enter a new index, in ``increments`` parts by the hash of their ids, so that no step holds more
    than a part; the result does not depend on their number. A null or empty text is one empty line. A row without doc_id holds
    nothing and loses nothing. Rows that repeat a doc_id are one document. Of a key that a document holds several times,
    the smallest document keeps all lines and others lose all. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    index = LineIndex(spark)
    held = store.save(holders(docs), "holders")
    for part in range(increments):
        index.insert_holders(held.where(F.pmod(F.xxhash64("doc_id"), F.lit(increments)) == part))
    return index.keep(docs, held)


#: The contract in SQL.
LINES_SQL = r"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
split AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM rows),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
held AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10 AND doc_id IS NOT NULL
         GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT r, k.doc_id, line, i, coalesce(keeper <> k.doc_id, FALSE) AS dropped FROM keyed k LEFT JOIN held USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
