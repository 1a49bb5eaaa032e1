"""Writers with a privacy guard, and the summaries that go with them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from homespell.session import scratch_path, shuffles_dropped

#: Markets that a task writes at once; only where it meets more are its rows sorted by market.
OPEN_FILES = 16

# Column-name fragments that identify a person or an address.
PII_TOKENS = ("owner", "grantor", "grantee", "address", "streetnum", "streetname", "deednumber")


def unsafe_columns(columns: Iterable[str], tokens: Sequence[str] = PII_TOKENS) -> list[str]:
    return [name for name in columns if any(t in name.lower().replace("_", "") for t in tokens)]


def guard_columns(df: DataFrame) -> DataFrame:
    unsafe = unsafe_columns(df.columns)
    if unsafe:
        raise ValueError(f"refusing to write columns that may identify a person: {unsafe}")
    return df


# Fixed values of this library: words that only the names of parties hold, and kinds of streets.
PARTY_WORDS = ("LLC", "INC", "CORP", "LP", "TRUST", "TRUSTEE", "ESTATE", "CHURCH", "BANK")
STREET_WORDS = ("ST", "STREET", "AVE", "AVENUE", "RD", "ROAD", "DR", "DRIVE", "LN", "LANE", "BLVD", "CT", "COURT", "WAY")


def identifying(value: Column) -> Column:
    """Whether a text reads as a party's name or a street address; null and empty texts do not."""
    words = F.filter(F.split(F.upper(value), "[^A-Z0-9]+"), lambda word: word != "")
    among = lambda kinds: F.arrays_overlap(words, F.array(*[F.lit(kind) for kind in kinds]))
    number = F.coalesce(F.get(words, F.lit(0)).rlike("^[0-9]{1,6}$"), F.lit(False))
    return F.coalesce(among(PARTY_WORDS) | (number & among(STREET_WORDS)), F.lit(False))


def privacy_audit(df: DataFrame) -> DataFrame:
    """``unsafe, passed_rows, refused_rows`` of a table, in one aggregate over the values of all text columns.

    A row is refused where a text identifies somebody or a column whose name does holds a value; ``unsafe`` counts the columns in
    which that happens.
    """
    named = set(unsafe_columns(df.columns))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    flags = {name: F.col(name).isNotNull() if name in named else identifying(F.col(name)) for name in dict.fromkeys([*texts, *named])}
    any_flag = reduce(or_, flags.values(), F.lit(False))
    judged = df.select(*[flag.alias(f"_flag_{at}") for at, flag in enumerate(flags.values())], any_flag.alias("_any"))
    unsafe = reduce(add, [F.coalesce(F.max(F.col(f"_flag_{at}").cast("int")), F.lit(0)) for at in range(len(flags))], F.lit(0))
    return judged.agg(unsafe.alias("unsafe"), F.count_if(~F.col("_any")).alias("passed_rows"), F.count_if("_any").alias("refused_rows"))


def guard_values(df: DataFrame) -> DataFrame:
    """``df``, unless a row of it identifies somebody."""
    refused = privacy_audit(df).first()["refused_rows"]
    if refused:
        raise ValueError(f"{refused} rows may identify a person")
    return df


def write_safe_table(df: DataFrame, path: str, mode: str = "errorifexists", **options: str) -> dict[str, int]:
    """Write by market through the job commit protocol; returns the number of rows written."""
    seen = Observation("written")
    guarded = guard_columns(df).observe(seen, F.count(F.lit(1)).alias("rows"))
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(OPEN_FILES))
    try:
        guarded.write.mode(mode).options(**options).partitionBy("market").parquet(path)
    finally:
        conf.set(name, before)
    return dict(seen.get)


def prepare_table(df: DataFrame, name: str = "prepared") -> DataFrame:
    """Write the safe table once below the shared folder and read it back.

    Parsing then runs a single time, and every later step prunes columns and pushes filters into
    the columnar files instead of repeating the parsing expressions in its own predicates.
    """
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        write_safe_table(df, path, compression="zstd")
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_path = path
    return table


def preparation_manifest(prepared: DataFrame, raw_counts: DataFrame,
                         observation_ends: DataFrame) -> DataFrame:
    """Input and output rows, columns and observation end per market, with privacy assertions."""
    guard_columns(prepared)
    columns = ",".join(name for name in prepared.columns)
    written = prepared.groupBy("market").agg(F.count(F.lit(1)).alias("output_rows"))
    return (
        raw_counts.join(written, "market", "left")
        .join(observation_ends, "market", "left")
        .select(
            "market",
            "input_rows",
            F.coalesce("output_rows", F.lit(0)).cast("bigint").alias("output_rows"),
            F.lit(columns).alias("columns"),
            "observation_end",
            F.lit("false").alias("party_names_retained"),
            F.lit("false").alias("street_addresses_retained"),
            F.lit("false").alias("coordinates_retained"),
            F.lit("false").alias("raw_parcel_ids_retained"),
            F.lit("true").alias("market_namespaced_parcel_ids_hashed"),
        )
    )


def export_csv(df: DataFrame, path: str, fields: Sequence[str], order: Sequence[str] = ()) -> None:
    """Aggregate rows as CSV with a fixed column order; the order of rows is total if given."""
    table = guard_columns(df.select(*fields))
    if order:
        table = table.orderBy(*order)
    table.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    guard_columns(df).write.mode("overwrite").json(path)
