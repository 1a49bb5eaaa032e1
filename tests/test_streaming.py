"""State that streams carry over triggers, restarts and compactions."""

import pytest
from pyspark.sql import functions as F

from homespell.sources import sinks
from homespell.streaming import incremental

SCHEMA = "market string, sale_date date, sale_price double, is_base boolean, is_official boolean, is_proxy boolean, seq int"


def rows(market, days, first):
    return [(market, f"2024-01-{day:02d}", 50_000.0, day % 2 == 0, day % 3 == 0, day % 5 == 0, first + at) for at, day in enumerate(days)]


FILES = [rows("a", [3, 9], 0) + rows("b", [4], 10), rows("a", [5, 6], 20), rows("b", [20, 2, 8], 30) + rows("c", [1], 40), rows("a", [30], 50)]


@pytest.fixture
def folder(spark, tmp_path):
    def add(number):
        day = F.to_date("day")
        df = spark.createDataFrame(FILES[number], SCHEMA.replace("sale_date date", "day string")).withColumn("sale_date", day).drop("day")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return add


def stream(spark, tmp_path):
    return incremental.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, "parquet", files_per_trigger=1)


@pytest.mark.parametrize("mode, build", [("update", incremental.observation_end_stream), ("complete", incremental.source_count_stream)])
def test_state_over_triggers_a_restart_and_compaction(spark, tmp_path, folder, mode, build):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        incremental.run_to_table(build(stream(spark, tmp_path)), out, checkpoint, mode)
        return sorted(map(tuple, incremental.latest_rows(spark, out, "market").collect()))

    def expected(n):
        seen = spark.createDataFrame([x for part in FILES[:n] for x in part], SCHEMA.replace("sale_date date", "day string")).withColumn("sale_date", F.to_date("day"))
        return sorted(map(tuple, build(seen).collect()))

    folder(0)
    folder(1)
    assert run() == expected(2)
    assert len(incremental._written(spark, out, "batch")) == 2
    folder(2)
    assert run() == expected(3) and len(incremental._written(spark, out, "batch")) == 3
    incremental.compact(spark, out, "market")
    assert not incremental._written(spark, out, "batch") and list(incremental._written(spark, out, "snapshot")) == [2]
    # Nothing new: nothing changes.
    assert run() == expected(3)
    folder(3)
    assert run() == expected(4)
    incremental.compact(spark, out, "market")
    incremental.compact(spark, out, "market")
    assert sorted(map(tuple, incremental.latest_rows(spark, out, "market").collect())) == expected(4)


def test_batches_that_a_snapshot_holds_are_passed_over(spark, tmp_path, folder):
    """A compaction that was stopped before it deleted anything."""
    out = str(tmp_path / "out")
    folder(0)
    folder(1)
    incremental.run_to_table(incremental.source_count_stream(stream(spark, tmp_path)), out, str(tmp_path / "checkpoint"), "complete")
    before = sorted(map(tuple, incremental.latest_rows(spark, out, "market").collect()))
    incremental._newest(incremental._current(spark, out), "market").write.parquet(f"{out}/snapshot={1:012d}")
    assert sorted(map(tuple, incremental.latest_rows(spark, out, "market").collect())) == before
    incremental.compact(spark, out, "market")
    assert sorted(map(tuple, incremental.latest_rows(spark, out, "market").collect())) == before
    assert not incremental._written(spark, out, "batch")


def test_safe_rows_arrive_once(spark, tmp_path, folder):
    def run():
        incremental.stream_sanitize(stream(spark, tmp_path), lambda df: df, str(tmp_path / "safe"), str(tmp_path / "checkpoint"))
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "safe")).collect())

    folder(0)
    folder(1)
    assert run() == sorted(x[-1] for part in FILES[:2] for x in part)
    folder(2)
    assert run() == sorted(x[-1] for part in FILES[:3] for x in part)


def test_guard_looks_at_values(spark):
    names = ["Smith Family TRUST", "12 Oak Street", "12 oak", "Oak Street", "", None, "st 12", "TRUSTY", "OFFERPADLLC", "1234567 Elm Rd", "Bank-owned"]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "note string, k int")
    flags = [r[0] for r in df.orderBy("k").select(sinks.identifying(F.col("note"))).collect()]
    assert flags == [True, True, False, False, False, False, False, False, False, False, True]
    audit = sinks.privacy_audit(df.withColumn("Owner_Name", F.when(F.col("k") == 2, "x"))).first()
    assert (audit.unsafe, audit.passed_rows, audit.refused_rows) == (2, 7, 4)
    assert sinks.guard_values(df.where("k in (2, 3)")).count() == 2
    with pytest.raises(ValueError):
        sinks.guard_values(df)
    empty = sinks.privacy_audit(df.limit(0)).first()
    assert (empty.unsafe, empty.passed_rows, empty.refused_rows) == (0, 0, 0)
