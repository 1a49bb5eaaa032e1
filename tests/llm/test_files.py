import hashlib
import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from homespell.llm import store, token_records, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_crc32c(data):
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
    return value ^ 0xFFFFFFFF


def test_checksums():
    random = np.random.default_rng(0)
    blocks = [random.bytes(n) for n in (0, 1, 2, 3, 7, 8, 9, 31, 64, 65, 1000)] + [b"123456789"]
    assert token_records.checksums(blocks).tolist() == [plain_crc32c(x) for x in blocks]
    assert token_records.checksums([b"123456789"])[0] == 0xE3069283


def test_damaged_records_are_refused():
    record = token_records.frame([token_records.serialize(5, np.array([1, 2, 3]), 2)])[0]
    assert token_records.parse(token_records.unframe([record])[0])[1].tolist() == [1, 2, 3]
    for at in (0, 9, 20, len(record) - 1):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            token_records.unframe([bytes(broken)])


def test_records_round_trip(docs, empty_docs):
    rows = sorted(token_records.round_trip(docs.withColumnRenamed("source", "start"), PATH).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(PATH)
    expected = []
    for r in docs.collect():
        ids = np.array([*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 2], "<u4")
        expected.append((r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.n_tokens, r.ids_crc32)) for r in rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert token_records.round_trip(empty_docs, PATH).count() == 0


def test_files_are_read_in_parallel(spark, docs, monkeypatch):
    """As many tasks as files, and no window over all of them."""
    monkeypatch.setattr(token_records, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    folder = store.fresh_path(spark, "records")
    files = token_records.write(docs, folder, PATH)
    read = token_records.read(files, folder)
    assert files.count() > 4 and read.rdd.getNumPartitions() == files.count()
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html", "1 as digest", "2 as salt", "3 as payload")
    archives = warc.write(pages, folder + "-pages")
    assert archives.count() > 2 and warc.read(archives, folder + "-pages").rdd.getNumPartitions() == archives.count()
    assert warc.round_trip(pages).count() == docs.count()


def test_shuffled_reads(spark, docs, monkeypatch):
    folder = store.fresh_path(spark, "records")
    files = token_records.write(docs, folder, PATH).orderBy("range", "part").collect()
    access, plain = store.open_folder(folder)
    straight, shuffled = [], []
    for row in files:
        order = np.random.default_rng(1).permutation(row.records)
        for into, some in ((straight, np.arange(row.records)), (shuffled, order)):
            into += [(doc_id, ids.tolist()) for doc_id, ids in token_records.read_shuffled(access, plain, row.file, some)]
    assert straight != shuffled and sorted(map(str, straight)) == sorted(map(str, shuffled)) and len(straight) == docs.count()


def test_archives_round_trip(spark):
    big, other = "<p>" + "same " * 400, "x" * 999
    rows = [(1, "http://a/", big), (2, None, big), (3, "u\r\nv", other), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "é" * 600),
            (8, "u", big + "!"), (8, "u", big + "!"), (None, "u", "id missing " * 200), (9, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(map(str, map(tuple, warc.round_trip(pages).collect())))
    expected = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        most = max((p for p, _, h in rows if h == html and p is not None), default=page_id)
        revisit = len(payload) >= 1000 and most != page_id
        expected.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", most if revisit else None))
    assert found == sorted(map(str, expected))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_dictionary_frame_and_validation():
    records = [warc.record(k, f"http://site/{k}", f"<html><body>page number {k} of many pages</body></html>".encode() * 9, None) for k in range(200)]
    data = b"".join(warc.frames(records))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == bytes.fromhex("37a430ec")
    assert list(warc.read_frames(io.BytesIO(data))) == records
    # A dictionary that is itself compressed.
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size:]
    assert list(warc.read_frames(io.BytesIO(again))) == records
    with pytest.raises(zstandard.ZstdError):
        list(warc.read_frames(io.BytesIO(data[8 + size:])))
    with pytest.raises(ValueError):
        list(warc.read_frames(io.BytesIO(data[:-3])))
    assert warc.parse(records[3])[:2] == (3, len(records[3].partition(b"\r\n\r\n")[2]) - 4)
    for old, new in ((b"WARC/1.1", b"WARC/9"), (b"Content-Length: ", b"Content-Length: 1"), (b"page number", b"page numbeR"), (b"WARC-Date", b"WARC-Late")):
        with pytest.raises(ValueError):
            warc.parse(records[3].replace(old, new))


def test_long_records_cross_read_blocks():
    records = [np.random.default_rng(k).bytes(100_000) for k in range(3)]
    assert list(warc.read_frames(io.BytesIO(b"".join(warc.frames(records))))) == records
