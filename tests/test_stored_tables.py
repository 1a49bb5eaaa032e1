"""Large files and tables stored as folders."""

import hashlib

import pytest
from pyspark.sql import functions as F

from homespell.plans import ingest_queries
from homespell.sources import deeds


def test_digest_of_a_file_above_two_gigabytes(spark, tmp_path):
    size = 2**31 + 10
    with open(tmp_path / "large file.bin", "wb") as out:
        out.write(b"first")
        out.truncate(size)
    (tmp_path / "small.gz").write_bytes(b"not compressed")
    found = {r.source: r for r in deeds.input_provenance(spark, str(tmp_path)).collect()}
    with open(tmp_path / "large file.bin", "rb") as own:
        assert found["large file.bin"].sha256 == hashlib.file_digest(own, "sha256").hexdigest() and found["large file.bin"].bytes == size
    assert found["small.gz"].sha256 == hashlib.sha256(b"not compressed").hexdigest()
    assert len(found) == 2


def test_where_only_spark_opens_the_files(spark, tmp_path, monkeypatch):
    (tmp_path / "one").write_bytes(b"1")
    monkeypatch.setattr(deeds, "_tasks_can_open", lambda path: False)
    assert deeds.input_provenance(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"1").hexdigest()


@pytest.mark.parametrize("opens", [True, False])
def test_digests_of_blocks(spark, tmp_path, monkeypatch, opens):
    """A file is known by the digests of its blocks, which different tasks read."""
    content = {"long": bytes(range(256)) * 50, "even": b"x" * 3000, "empty": b"", "short": b"1"}
    for name, own in content.items():
        (tmp_path / name).write_bytes(own)
    monkeypatch.setattr(deeds, "_tasks_can_open", lambda path: opens)
    found = {r.path.rsplit("/", 1)[1]: r for r in deeds.block_provenance(spark, str(tmp_path), 1000).collect()}
    assert "empty" not in found
    for name, own in content.items() - {("empty", b"")}:
        parts = [own[at:at + 1000] for at in range(0, max(len(own), 1), 1000)]
        digest = hashlib.sha256("".join(hashlib.sha256(x).hexdigest() for x in parts).encode()).hexdigest()
        assert (found[name].blocks, found[name].blocks_sha256) == (len(parts), digest)
    if opens:
        blocks = deeds.block_digests(spark, str(tmp_path), 1000)
        assert blocks.rdd.getNumPartitions() == blocks.count() == 17


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_stored_as_folders(spark, tmp_path, files):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    lineitem.withColumn("_at", F.rand(1)).repartition(files, "_at").drop("_at").write.parquet(str(tmp_path / "lineitem.parquet"))
    queries = ingest_queries.registry.queries
    for name in ("a5_stream_sanitize", "l1_stream_observation_end", "l2_stream_source_counts"):
        single = queries[name].run(spark, "/root/testdata/sf0.001")
        folder = queries[name].run(spark, str(tmp_path))
        assert sorted(map(str, folder.collect())) == sorted(map(str, single.collect())) and single.count()
