"""Web archives of one Zstandard frame per record, with a dictionary in a leading skippable frame.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, if there is one;
each further frame is one WARC record. Writing: payloads of at least ``LEAST_REVISIT`` bytes that
occur more than once are stored with the page of the largest id; the others are revisit records that
name it. Reading: the dictionary is loaded, frames are decoded one at a time, and each record's
version, headers, block length and payload digest are validated; a broken one raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import map_partitions

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
DICTIONARY_MAGIC, FRAME_MAGIC = 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

LEAST_REVISIT = 1000
LEVEL = 3
#: A file's dictionary: its size, and the records and bytes of each that it is trained on at most.
DICTIONARY_BYTES, DICTIONARY_RECORDS, DICTIONARY_SHARE = 16_384, 200, 4_096
#: Parts that pages of one payload are dealt to.
SALT = 32
#: Greatest length that a reader accepts of a skippable frame.
MOST_DICTIONARY = 1 << 27


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without it that names the response's page."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    head += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Payload-Length", str(len(payload)))]
    block = payload if refers_to is None else b""
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from evenly spaced records; None where they are too few to train one."""
    spaced = samples[::max(1, len(samples) // DICTIONARY_RECORDS)]
    pieces = [x[:DICTIONARY_SHARE] for x in spaced if x]
    if len(pieces) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces)
    except zstandard.ZstdError:
        return None


def frames(records: list[bytes]) -> Iterator[bytes]:
    """The skippable dictionary frame, then a frame for each record."""
    trained = dictionary_of(records)
    if trained is not None:
        content = trained.as_bytes()
        yield struct.pack("<II", SKIPPABLE, len(content)) + content
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    for own in records:
        yield compressor.compress(own)


def read_frames(source: BinaryIO) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time."""
    head = source.read(8)
    trained = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", head[4:])[0]
        if size > MOST_DICTIONARY:
            raise ValueError(f"dictionary frame of {size} bytes")
        content = source.read(size)
        if len(content) != size:
            raise ValueError("dictionary frame is cut off")
        if content[:4] == struct.pack("<I", FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content, max_output_size=MOST_DICTIONARY)
        if content[:4] != struct.pack("<I", DICTIONARY_MAGIC):
            raise ValueError("no dictionary in the leading frame")
        trained = zstandard.ZstdCompressionDict(content)
        head = b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    rest = head
    while True:
        rest = rest or source.read(32_768)
        if not rest:
            return
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(32_768)
            if not rest:
                raise ValueError("frame is cut off")
        yield b"".join(out)


def _page(urn: str) -> int | None:
    if not (urn.startswith("<urn:page:") and urn.endswith(">")):
        raise ValueError(f"record name {urn!r}")
    return int(urn[10:-1]) if urn[10:-1] else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a validated record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ValueError("no WARC/1.1 record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in fields:
            raise ValueError(f"header line {line!r}")
        fields[name.lower()] = value
    if missing := {"warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "warc-payload-length", "content-length"} - fields.keys():
        raise ValueError(f"no {', '.join(sorted(missing))}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest)} bytes, {size} announced")
    kind, length = fields["warc-type"], int(fields["warc-payload-length"])
    name, _, code = fields["warc-payload-digest"].partition(":")
    digest = base64.b32decode(code).hex()
    if kind == "response":
        if size != length or name != "sha1" or hashlib.sha1(rest[:size]).hexdigest() != digest:
            raise ValueError("payload differs from its length or digest")
        return _page(fields["warc-record-id"]), length, digest, kind, None
    if kind != "revisit" or size or fields.get("warc-profile") != PROFILE:
        raise ValueError(f"record of type {kind!r}")
    return _page(fields["warc-record-id"]), length, digest, kind, _page(fields["warc-refers-to"])


def with_responses(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``. Ids and digests are compared, and pages of one payload are
    dealt to ``SALT`` parts, so a payload that many pages share stays spread."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = (rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest")
              .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    return (salted.join(shared, ["digest", "salt"], "left")
            .select("page_id", "url", "payload", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to")))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder``, one per task; ``file, records`` of each, from committed tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, part, waiting, size = TaskContext.get(), 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, size, part
            name = f"pages-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.warc.zst"
            store.put_file(folder, name, context.taskAttemptId(), frames(waiting))
            done = pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([len(waiting)], pa.int64())})
            waiting, size, part = [], 0, part + 1
            return done

        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("page_id", "url", "payload", "refers_to")]
            for page_id, url, payload, refers_to in zip(*columns):
                waiting.append(record(page_id, url, payload, refers_to))
                size += len(waiting[-1])
                if size >= FILE_BYTES:
                    yield close()
        if waiting:
            yield close()

    return store.save(map_partitions(with_responses(pages), run, "file string, records long"), "archives")


#: Bytes of records after which a task starts another file.
FILE_BYTES = 64_000_000


def read(files: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record of the listed files."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        access, plain = store.open_folder(folder)
        for batch in batches:
            for file, announced in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, count = [], 0
                with access.open_input_stream(f"{plain}/{file}", compression=None) as source:
                    for raw in read_frames(source):
                        rows.append(parse(raw))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            count, rows = count + len(rows), []
                if count + len(rows) != announced:
                    raise ValueError(f"{file}: {count + len(rows)} records, {announced} were written")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_partitions(store.spread(files), run, ", ".join(f"{n} {'string' if n in ('payload_digest', 'record_type') else 'long'}" for n in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder and read them back.

    A null html is an empty payload, a null url is left out, a null page_id stays null. Rows that repeat the
    largest page_id of a payload are all responses. An empty table writes nothing and gives no rows.
    """
    folder = store.fresh_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
