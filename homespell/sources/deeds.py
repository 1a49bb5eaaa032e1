"""Readers of raw deed files and their projection to the canonical transaction table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from homespell.functions import scalars as S
from homespell.schemas import TRANSACTIONS, all_strings
from homespell.session import ship

#: Bytes of a file that a task holds while it hashes.
BLOCK_BYTES = 8 << 20
#: Bytes of a block that has a digest of its own, and tasks that read blocks at most.
PROVENANCE_BYTES, MOST_READERS = 64 << 20, 10_000

# Source column aliases in order of preference.
ALIASES_A = {
    "parcel": ("PIN", "FOLIO", "PARCEL_ID", "PARCEL"),
    "sale_date": ("S_DATE", "SALE_DATE", "SALEDATE"),
    "sale_price": ("S_AMT", "SALE_AMOUNT", "SALE_PRICE"),
    "qualified": ("QU", "QUALIFIED", "QUAL", "QUAL_FLAG"),
    "property_type_code": ("DOR_CODE", "DOR"),
    "dor_code": ("DOR_CODE", "DOR"),
    "improved": ("VI", "IMP_VAC", "IMPROVED"),
    "instrument_type": ("S_TYPE", "INSTRUMENT", "INSTR_TYPE", "STR"),
    "neighborhood": ("NBHC", "NBRHD", "NEIGHBORHOOD"),
    "subdivision": ("SUB", "S_DIV", "SUBDIVISION"),
    "grantee": ("GRANTEE",),
    "grantor": ("GRANTOR",),
}
ALIASES_B = {
    "parcel": ("PARCEL", "PARCEL_ID", "PARCELID", "PARCELNO", "PARCEL_NUMBER", "PID"),
    "sale_date": ("SALE_DATE", "SALEDATE", "SALE_DT", "DATE_OF_SALE"),
    "sale_price": ("SALE_AMOUNT", "SALE_AMT", "SALE_PRICE", "SALEPRICE"),
    "adjusted_sale_price": (
        "ADJUSTED_SALE_AMOUNT", "ADJ_SALE_AMOUNT", "ADJ_SALE_AMT", "SALE_ADJ_AMOUNT",
    ),
    "qualified": ("SALE_DESCRIPTION",),
    "property_type_code": ("SALE_TYPE", "PROPERTY_TYPE", "PROPERTY_TYPE_CODE", "DOR_CODE", "DOR"),
    "dor_code": ("DOR_CODE", "DOR"),
    "improved": ("VAC_IMPR_CODE", "IMPROVED", "IMP_VAC"),
    "instrument_type": ("DEED_CODE", "DEED_TYPE"),
    "year_built": ("AYB", "ACTUAL_YEAR_BUILT", "ACTUAL_YR_BUILT", "YEAR_BUILT", "YR_BUILT"),
    "effective_year_built": ("EYB", "EFFECTIVE_YEAR_BUILT", "EFFECTIVE_YR_BUILT", "EFF_YEAR_BUILT"),
    "living_area_sqft": ("LIVING_AREA", "LIVING_AREA_SQFT", "LIV_AREA", "HEATED_AREA"),
    "gross_area_sqft": ("GROSS_AREA", "GROSS_AREA_SQFT", "TOTAL_AREA"),
    "beds": ("BEDROOMS", "BEDS", "BED_COUNT"),
    "baths": ("BATH", "BATHS", "BATHROOMS", "BATH_COUNT"),
    "stories": ("STYS", "STORIES", "STORY_COUNT"),
    "pool": ("POOL", "HAS_POOL", "POOL_IND"),
    "neighborhood": ("NBHD_CODE", "NEIGHBORHOOD", "NBHD", "NBRHD"),
    "subdivision": ("SUBDIVISION_NAME", "SUBDIVISION", "SUBDIV", "SUBDIV_NAME"),
    "census_block_group": ("BLKGROUPID", "CENSUS_BLOCK_GROUP", "BLOCK_GROUP", "BLOCKGROUP"),
    "grantee": ("GRANTEE",),
    "grantor": ("GRANTOR",),
}
_NUMBERS = frozenset(
    f.name for f in TRANSACTIONS if isinstance(f.dataType, T.DoubleType)
)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, anything malformed fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on input that cannot be split, such as one gzip file or one row group.

    Input that already has at least as many splits as the cluster has cores is left alone, and its predicates reach the
    scan. Others would be worked out before the rows are spread, all by the task of the one split; they are not moved past an
    observation of the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores).observe(f"spread-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def non_object_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold something other than one JSON object."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(~F.col("value").rlike(r"^\s*\{"))


def scan_fixed_width(lines: DataFrame, layout: Sequence[tuple[str, int]],
                     value: str = "value") -> DataFrame:
    """Slice fixed-width records by (name, length); the first byte marks deleted records."""
    fields, position = [], 2
    for name, length in layout:
        fields.append(S.strip(F.substring(value, position, length)).alias(name))
        position += length
    return lines.filter(F.substring(value, 1, 1) != "*").select(*fields)


def scan_csv_typed(spark: SparkSession, path: str,
                   schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """CSV read as text and cast by declared type, so a bad value is null and codes stay text."""
    raw = spark.read.schema(all_strings(schema)).option("header", True).csv(path)
    return raw.select(*[_typed(field).alias(field.name) for field in schema])


def _typed(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.col(field.name)
    if isinstance(field.dataType, T.DateType):
        return S.parse_date(field.name)
    return F.col(field.name).try_cast(field.dataType)


def _canonical(df: DataFrame, parsed: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    columns = [
        parsed.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
        for field in TRANSACTIONS
    ]
    return df.filter(S.safe_text("parcel").isNotNull()).select(*columns, *keep)


def _with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]], keep: Sequence[str]) -> DataFrame:
    found = {field: S.alias_column(df.columns, names) for field, names in aliases.items()}
    picked = [
        (F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")).alias(field)
        for field, name in found.items()
    ]
    return df.select(*picked, *keep)


def _parsed(fields: Sequence[str], market: str, qualified) -> dict[str, Column]:
    parsers = {
        "sale_date": S.parse_date, "qualified": qualified, "improved": S.parse_improved,
        "pool": S.parse_boolean,
    }
    parsed = {"market": F.lit(market), "parcel_id": S.hash_parcel(F.lit(market), "parcel")}
    for field in fields:
        if field in ("parcel", "grantee", "grantor"):
            continue
        default = S.parse_number if field in _NUMBERS else S.safe_text
        parsed[field] = parsers.get(field, default)(field)
    parsed["buyer_operator"] = S.classify_operator("grantee")
    parsed["seller_operator"] = S.classify_operator("grantor")
    return parsed


def normalize_market_a(raw: DataFrame, market: str = "market_a",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Flat county rows to the canonical schema; party names and raw ids do not survive."""
    named = _with_aliases(raw, ALIASES_A, keep)
    return _canonical(named, _parsed(list(ALIASES_A), market, S.parse_qualified), keep)


def normalize_market_b(raw: DataFrame, market: str = "market_b",
                       keep: Sequence[str] = ()) -> DataFrame:
    """Nested county records to the canonical schema; rows without attributes are dropped."""
    if "attributes" in raw.columns:
        raw = raw.filter(F.col("attributes").isNotNull()).select("attributes.*", *keep)
    named = _with_aliases(raw, ALIASES_B, keep)
    return _canonical(named, _parsed(list(ALIASES_B), market, S.qualified_from_description), keep)


def union_markets(*tables: DataFrame) -> DataFrame:
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and plain path of a file that Spark has listed."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


def _tasks_can_open(path: str) -> bool:
    try:
        _opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path in batch.column("path").to_pylist():
            access, plain = _opened(path)
            digest = hashlib.sha256()
            with access.open_input_stream(plain, compression=None) as source:
                while block := source.read(BLOCK_BYTES):
                    digest.update(block)
            digests.append(digest.hexdigest())
        yield batch.append_column("sha256", pa.array(digests, pa.string()))


def input_provenance(spark: SparkSession, path: str, prior: DataFrame | None = None) -> DataFrame:
    """Digest, size and retrieval time per file; an unchanged file keeps its first time.

    A file is known by its whole path, so equal names in two folders stay apart. A task reads its files
    block by block, so they may have any size; files are dealt to tasks by their bytes. Only where
    no library but Spark can open the file system is a file's content held in one row, below 2 GB.
    """
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").first()
    if first is None or _tasks_can_open(first["path"]):
        ship(spark)
        kept = listed.select("path", "length", "modificationTime")
        hashed = kept.mapInArrow(_streamed_digests, "path string, length long, modificationTime timestamp, sha256 string")
    else:
        hashed = listed.withColumn("sha256", F.sha2("content", 256))
    files = hashed.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("source"),
        "sha256",
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    if prior is None:
        return files.withColumnRenamed("modified_at", "retrieved_at")
    known = prior.select("path", "sha256", "bytes", F.col("retrieved_at").alias("_known"))
    return files.join(known, ["path", "sha256", "bytes"], "left").select(
        "path", "source", "sha256", "bytes", F.coalesce("_known", "modified_at").alias("retrieved_at")
    )


def _block_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = []
        for path, offset, length in zip(*(batch.column(name).to_pylist() for name in ("path", "offset", "length"))):
            access, plain = _opened(path)
            digest = hashlib.sha256()
            with access.open_input_file(plain) as source:
                source.seek(offset)
                while length and (part := source.read(min(length, BLOCK_BYTES))):
                    digest.update(part)
                    length -= len(part)
            if length:
                raise ValueError(f"{path} has become shorter")
            digests.append(digest.hexdigest())
        yield batch.append_column("sha256", pa.array(digests, pa.string()))


def block_digests(spark: SparkSession, path: str, block_bytes: int = PROVENANCE_BYTES) -> DataFrame:
    """``path, offset, length, sha256`` of each block of the files; blocks of one file are read by different tasks.

    Spark lists no empty files, so these have no block.
    """
    listed = spark.read.format("binaryFile").load(path)
    first = listed.select("path").first()
    blocks = listed.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(block_bytes).cast("long")))) \
        .withColumn("length", F.least(F.lit(block_bytes), F.col("length") - F.col("offset")))
    if first is None or _tasks_can_open(first["path"]):
        ship(spark)
        rows = blocks.select("path", "offset", "length")
        # A number, so that rows as small as these are not merged into one task.
        spread = rows.repartition(max(1, min(rows.count(), MOST_READERS)))
        return spread.mapInArrow(_block_digests, "path string, offset long, length long, sha256 string")
    part = F.substr("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return blocks.select("path", "offset", "length", F.sha2(part, 256).alias("sha256"))


def block_provenance(spark: SparkSession, path: str, block_bytes: int = PROVENANCE_BYTES) -> DataFrame:
    """``path, blocks, blocks_sha256`` per file: the SHA-256 of its blocks' digests (lower-case hex) in order.

    It tells a file as well as a plain digest does, and a file of any size takes as long as its blocks, shared among all tasks.
    """
    digests = F.transform(F.array_sort(F.collect_list(F.struct("offset", "sha256"))), lambda x: x["sha256"])
    return block_digests(spark, path, block_bytes).groupBy("path").agg(
        F.count(F.lit(1)).alias("blocks"), F.sha2(F.array_join(digests, "").cast("binary"), 256).alias("blocks_sha256"))


def latest_snapshot(files: DataFrame, path: str = "path") -> DataFrame:
    """Newest release among names that carry ``MM_DD_YYYY``; undated names come last."""
    part = [F.regexp_extract(path, r"(\d{2})_(\d{2})_(\d{4})", i) for i in (1, 2, 3)]
    release = F.concat(part[2], part[0], part[1])
    return files.agg(F.max_by(F.col(path), F.struct(release, path)).alias("latest"))


def source_provenance(records: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """JSON of the allowed public fields per source, without the null ones."""
    kept = [name for name in allowed if name in records.columns]
    public = F.to_json(F.struct(*kept), {"ignoreNullFields": "true"})
    return records.select(F.col(key), public.alias("provenance"))
