"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is framed as length (8 bytes), masked checksum of the length (4), data, masked checksum of
the data (4), all little-endian; checksums are CRC-32C. The data is the doc_id (8 bytes, signed), the
number of ids (8), the width of an id (1) and the ids, in 2 bytes each where the vocabulary allows it, else 4.
A separate index file holds the offset and size of each record (8 bytes each), so that records can be read in
any order without passing over the others.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import map_partitions
from homespell.llm.token_cache import encoder
from homespell.operators.scale import Carried, order_groups

#: Fixed values of the format: the CRC-32C polynomial (reflected) and the mask of checksums.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
END_ID = 2
#: Least and greatest doc_id stand for a missing one; nulls are written first.
NO_ID = -(2**63)
#: Bytes of records after which a task starts another file.
FILE_BYTES = 64_000_000


@functools.lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(POLYNOMIAL), value >> 1).astype(np.uint32)
    return value


@functools.lru_cache(maxsize=48)
def _shift_tables(level: int) -> np.ndarray:
    """Four tables that append ``2 ** level`` zero bytes to a checksum, one byte of it each."""
    if level == 0:
        value = np.arange(256, dtype=np.uint32)
        table = np.stack([value << np.uint32(8 * k) for k in range(4)])
        return _byte_table()[table & 0xFF] ^ (table >> np.uint32(8))
    before = _shift_tables(level - 1)
    return _shifted(before, before)


def _shifted(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (tables[0][value & 0xFF] ^ tables[1][(value >> np.uint32(8)) & 0xFF]
            ^ tables[2][(value >> np.uint32(16)) & 0xFF] ^ tables[3][value >> np.uint32(24)])


def checksums(blocks: list[bytes]) -> np.ndarray:
    """CRC-32C of each block, many at a time.

    Without its initial value the checksum is linear and ignores zeros in front, so blocks are padded in
    front to a power of two and halves are joined level by level; the initial value, carried over the block's
    length, is added last.
    """
    sizes = np.array([len(x) for x in blocks], np.int64)
    out = np.zeros(len(blocks), np.uint32)
    # bit_length of size - 1: blocks of one class are padded to the same power of two.
    classes = np.array([max(0, int(x) - 1).bit_length() for x in sizes])
    for level in np.unique(classes):
        rows = np.flatnonzero(classes == level)
        width = 1 << int(level)
        for low in range(0, len(rows), max(1, 4_000_000 // width)):
            some = rows[low:low + max(1, 4_000_000 // width)]
            padded = np.frombuffer(b"".join(blocks[k].rjust(width, b"\0") for k in some), np.uint8).reshape(len(some), width)
            value = _byte_table()[padded]
            for step in range(int(level)):
                value = _shifted(_shift_tables(step), value[:, 0::2]) ^ value[:, 1::2]
            out[some] = value[:, 0]
    start = np.full(len(blocks), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        rows = np.flatnonzero((sizes >> bit) & 1)
        start[rows] = _shifted(_shift_tables(bit), start[rows])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def masked(value: np.ndarray) -> np.ndarray:
    return ((value >> np.uint32(15)) | (value << np.uint32(17))) + np.uint32(MASK)


def frame(blocks: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(x)) for x in blocks]
    heads, tails = masked(checksums(lengths)), masked(checksums(blocks))
    return [b"".join((length, struct.pack("<I", head), block, struct.pack("<I", tail)))
            for length, head, block, tail in zip(lengths, heads.tolist(), blocks, tails.tolist())]


def unframe(records: list[bytes]) -> list[bytes]:
    """Data of framed records; a wrong length or checksum raises."""
    blocks = [x[12:-4] for x in records]
    for own, block in zip(records, blocks):
        if len(own) < 16 or struct.unpack("<Q", own[:8])[0] != len(block):
            raise ValueError("record length differs from its frame")
    heads, tails = masked(checksums([x[:8] for x in records])), masked(checksums(blocks))
    for own, head, tail in zip(records, heads.tolist(), tails.tolist()):
        if struct.unpack("<I", own[8:12])[0] != head or struct.unpack("<I", own[-4:])[0] != tail:
            raise ValueError("record checksum differs")
    return blocks


def serialize(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<qQB", NO_ID if doc_id is None else doc_id, len(ids), width) + ids.astype(f"<u{width}").tobytes()


def parse(block: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, count, width = struct.unpack("<qQB", block[:17])
    ids = np.frombuffer(block, f"<u{width}", offset=17)
    if len(ids) != count:
        raise ValueError(f"{len(ids)} ids, {count} announced")
    return None if doc_id == NO_ID else doc_id, ids.astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write record and index files in ascending doc_id; ``range, part, file, records, n_tokens`` of each.

    Rows of one doc_id are in the order of their texts' hashes.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_key"))
    ordered = rows.repartitionByRange("doc_id", "row_key").sortWithinPartitions("doc_id", "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, units = TaskContext.get(), encoder(tokenizer, True)
        width = 2 if units.tokenizer.get_vocab_size() <= 65536 else 4
        waiting: list[bytes] = []
        size = tokens = part = 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, size, tokens, part
            name = f"tokens-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}"
            records = frame(waiting)
            sizes = np.array([len(x) for x in records], "<i8")
            index = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1)
            store.put_file(folder, f"{name}.records", context.taskAttemptId(), records)
            store.put_file(folder, f"{name}.index", context.taskAttemptId(), [index.astype("<i8").tobytes()])
            done = pa.RecordBatch.from_pydict({"range": pa.array([context.partitionId()], pa.int32()), "part": pa.array([part], pa.int32()),
                                               "file": [name], "records": pa.array([len(records)], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})
            waiting, size, tokens, part = [], 0, 0, part + 1
            return done

        for batch in batches:
            ids, offsets = units.ids(batch.column("text").to_pylist())
            for at, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offsets[at]:offsets[at + 1]], np.uint32(END_ID))
                waiting.append(serialize(doc_id, own, width))
                size, tokens = size + len(waiting[-1]), tokens + len(own)
                if size >= FILE_BYTES:
                    yield close()
        if waiting:
            yield close()

    return store.save(map_partitions(ordered.select("doc_id", "text"), run, "range int, part int, file string, records long, n_tokens long"), "records")


def read(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each record of the listed files, through their indexes."""
    ordered = order_groups(files, (), ["range", "part"]).carry(before=Carried("n_tokens", over="before")).result()
    listed = ordered.withColumn("before", F.coalesce("before", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        access, plain = store.open_folder(folder)
        for batch in batches:
            for file, announced, before in zip(*(batch.column(n).to_pylist() for n in ("file", "records", "before"))):
                with access.open_input_stream(f"{plain}/{file}.index", compression=None) as source:
                    index = np.frombuffer(source.read(), "<i8").reshape(-1, 2)
                if len(index) != announced:
                    raise ValueError(f"{file}: {len(index)} records, {announced} were written")
                with access.open_input_file(f"{plain}/{file}.records") as source:
                    for low in range(0, len(index), 2048):
                        some = index[low:low + 2048]
                        source.seek(int(some[0, 0]))
                        raw = source.read(int(some[-1].sum() - some[0, 0]))
                        base = int(some[0, 0])
                        rows = [parse(x) for x in unframe([raw[o - base:o - base + s] for o, s in some.tolist()])]
                        sizes = np.array([len(ids) for _, ids in rows], np.int64)
                        starts = before + np.cumsum(sizes) - sizes
                        before += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([doc_id for doc_id, _ in rows], pa.int64()), pa.array(starts), pa.array(sizes),
                             pa.array([zlib.crc32(ids.tobytes()) for _, ids in rows], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_partitions(store.spread(listed.select("file", "records", "before")), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_shuffled(access, plain: str, file: str, order: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of one file in any order, by seeking through the index."""
    with access.open_input_stream(f"{plain}/{file}.index", compression=None) as source:
        index = np.frombuffer(source.read(), "<i8").reshape(-1, 2)
    with access.open_input_file(f"{plain}/{file}.records") as source:
        for at in order.tolist():
            source.seek(int(index[at, 0]))
            yield parse(unframe([source.read(int(index[at, 1]))])[0])


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` (doc_id, text) as records in the shared folder and read them back.

    A null or empty text is the end id alone. Rows without doc_id come first and stay without; rows that repeat
    one follow each other. An empty table writes nothing and gives no rows.
    """
    folder = store.fresh_path(docs.sparkSession, "records")
    return read(write(docs, folder, tokenizer), folder)
