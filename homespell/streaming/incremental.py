"""Incremental versions of the chunked preparation steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homespell.session import scratch_path
from homespell.sources.sinks import guard_columns

Transform = Callable[[DataFrame], DataFrame]


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json",
                pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """New files below a folder as a stream with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def stream_sanitize(source: DataFrame, transform: Transform, output: str, checkpoint: str) -> None:
    """Append every file that arrived since the last run to the safe table, exactly once."""
    safe = guard_columns(transform(source))
    (
        safe.writeStream.format("parquet").partitionBy("market")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def observation_end_stream(sales: DataFrame, minimum_price: float = 10_000.0) -> DataFrame:
    """Running latest valid deed date per market; one state row per market."""
    valid = sales.filter(
        F.col("sale_date").isNotNull() & (F.col("sale_price") >= minimum_price)
        & F.col("market").isNotNull()
    )
    return valid.groupBy("market").agg(F.max("sale_date").alias("observation_end"))


def source_count_stream(flagged: DataFrame) -> DataFrame:
    """Running row and funnel counts per market."""
    base, official, proxy = F.col("is_base"), F.col("is_official"), F.col("is_proxy")
    return flagged.groupBy("market").agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(base).alias("base_rows"),
        F.count_if(base & (official | proxy)).alias("selected_rows"),
    )


def run_to_table(result: DataFrame, output: str, checkpoint: str, mode: str = "complete") -> None:
    """Drain an aggregation; ``update`` merges changed rows, ``complete`` replaces the table.

    Each batch writes its own folder, so a batch that is retried overwrites only itself. A later run with the
    same checkpoint takes only files that are new.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{output}/batch={batch_id:012d}"
        )

    (
        result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    )


def _written(spark: SparkSession, output: str, kind: str) -> dict[int, str]:
    """Complete folders of one kind below ``output``, by the number of their last batch."""
    found = {}
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{output}/{kind}=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        folder = status.getPath().getParent()
        found[int(folder.getName().split("=")[1])] = folder.toString()
    return found


def _current(spark: SparkSession, output: str) -> DataFrame | None:
    """Rows of the last snapshot and of the batches after it."""
    snapshots, batches = _written(spark, output, "snapshot"), _written(spark, output, "batch")
    last = max(snapshots, default=-1)
    folders = [batches[k] for k in sorted(batches) if k > last] + ([snapshots[last]] if snapshots else [])
    return spark.read.parquet(*folders) if folders else None


def _newest(rows: DataFrame, key: str) -> DataFrame:
    rest = [name for name in rows.columns if name != key]
    newest = F.max_by(F.struct(*rest), "batch_id").alias("newest")
    return rows.groupBy(key).agg(newest).select(key, "newest.*")


def latest_rows(spark: SparkSession, output: str, key: str) -> DataFrame:
    """Newest version of every key among the last snapshot and the batches after it."""
    return _newest(_current(spark, output), key).drop("batch_id")


def compact(spark: SparkSession, output: str, key: str) -> None:
    """Fold the written batches into one snapshot, so that a table that runs for years stays as large as its keys.

    The snapshot is complete before anything is deleted, and readers pass over batches that it holds, so a run that
    is stopped in between loses nothing. No stream may write meanwhile.
    """
    rows = _current(spark, output)
    batches, snapshots = _written(spark, output, "batch"), _written(spark, output, "snapshot")
    last = max([*batches, *snapshots], default=None)
    if last is None:
        return
    if last not in snapshots:
        _newest(rows, key).write.mode("overwrite").parquet(f"{output}/snapshot={last:012d}")
    for number, folder in [*batches.items(), *((k, f) for k, f in snapshots.items() if k < last)]:
        if number <= last:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drain(spark: SparkSession, result: DataFrame, key: str, mode: str) -> DataFrame:
    """Run an aggregation over all available files and return its final rows."""
    output = scratch_path(spark, "stream")
    run_to_table(result, output, scratch_path(spark, "stream-checkpoint"), mode)
    compact(spark, output, key)
    return latest_rows(spark, output, key)
