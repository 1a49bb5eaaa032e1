"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession

from homespell.session import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: it outlives executors and cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._llm_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_llm_path", None)
        if path:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def open_folder(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and plain path of a folder, for tasks that write or read files in it."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return arrow_fs.FileSystem.from_uri(uri)
    return arrow_fs.LocalFileSystem(), uri


def put_file(uri: str, name: str, attempt: int, chunks) -> None:
    """Write a file under a name of this attempt, then move it into place, so a lost or repeated
    task leaves either nothing or the whole file."""
    files, folder = open_folder(uri)
    files.create_dir(folder, recursive=True)
    partial = posixpath.join(folder, f".{name}.{attempt}")
    with files.open_output_stream(partial, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    files.move(partial, posixpath.join(folder, name))


#: Tasks that read files at most.
MOST_READERS = 50_000


def spread(files: DataFrame) -> DataFrame:
    """A saved list of files with a task for each; a number given to ``repartition`` is not merged afterwards."""
    return files.repartition(max(1, min(files.count(), MOST_READERS)))


def map_file(uri: str, name: str) -> np.ndarray:
    """A file's bytes, mapped into memory where its folder is a mounted one."""
    files, folder = open_folder(uri)
    path = posixpath.join(folder, name)
    if isinstance(files, arrow_fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with files.open_input_file(path) as source:
        return np.frombuffer(source.read(), np.uint8)
