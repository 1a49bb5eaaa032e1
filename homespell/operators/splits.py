"""Geographic and chronological splits that never reuse a parcel."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homespell.operators.scale import join_on

SPLITS = ("training", "calibration", "out_of_time_test")


@dataclass(frozen=True)
class Cutoffs:
    calibration_start: date
    test_start: date


def geographic_label(df: DataFrame, development: str, holdout: str) -> DataFrame:
    """Label rows by market role; rows of other markets are dropped."""
    if development == holdout:
        raise ValueError("development and holdout markets must differ")
    role = F.when(F.col("market") == development, "development").when(
        F.col("market") == holdout, "holdout"
    )
    return df.withColumn("sample", role).filter(F.col("sample").isNotNull())


def geographic_holdout(df: DataFrame, development: str, holdout: str) -> DataFrame:
    """``geographic_label`` that fails unless both samples have rows.

    Both samples carry the market in their key, so they cannot overlap.
    """
    labelled = geographic_label(df, development, holdout)
    found = {row[0] for row in labelled.select("sample").distinct().collect()}
    if found != {"development", "holdout"}:
        raise ValueError("both geographic samples must contain observations")
    return labelled


def key_overlap(left: DataFrame, right: DataFrame, key=("market", "parcel_id")) -> DataFrame:
    return left.select(*key).intersect(right.select(*key))


def date_cutoff_table(df: DataFrame, date_col: str, calibration_fraction: float = 0.2,
                      test_fraction: float = 0.2) -> DataFrame:
    """One row with the calibration and test start among the sorted distinct dates."""
    if not (0 < calibration_fraction < 0.5 and 0 < test_fraction < 0.5
            and calibration_fraction + test_fraction < 0.8):
        raise ValueError("fractions must lie in (0, 0.5) and leave a fifth of the dates")
    # Distinct calendar dates: a few thousand rows however large the table is.
    days = df.select(F.to_date(date_col).alias("day")).distinct()
    everything = Window.partitionBy(F.lit(0))
    placed = days.select(
        "day",
        (F.row_number().over(everything.orderBy("day")) - 1).alias("position"),
        F.count(F.lit(1)).over(everything).alias("n"),
    )
    n = F.col("n")
    calibration = F.floor(n * F.lit(1.0 - calibration_fraction - test_fraction))
    test = F.floor(n * F.lit(1.0 - test_fraction))
    at_calibration = F.least(F.greatest(calibration, F.lit(1)), n - 2)
    at_test = F.least(F.greatest(test, F.lit(2)), n - 1)
    return placed.agg(
        F.max("n").alias("n_dates"),
        F.max(F.when(F.col("position") == at_calibration, F.col("day"))).alias("calibration_start"),
        F.max(F.when(F.col("position") == at_test, F.col("day"))).alias("test_start"),
    )


def date_cutoffs(df: DataFrame, date_col: str, calibration_fraction: float = 0.2,
                 test_fraction: float = 0.2, calibration_start: str | None = None,
                 test_start: str | None = None) -> Cutoffs:
    if df.filter(F.col(date_col).isNull()).take(1):
        raise ValueError(f"{date_col} contains missing dates")
    row = date_cutoff_table(df, date_col, calibration_fraction, test_fraction).first()
    if row["n_dates"] is None or row["n_dates"] < 5:
        raise ValueError("a chronological split needs at least five distinct dates")
    cutoffs = Cutoffs(
        date.fromisoformat(calibration_start) if calibration_start else row["calibration_start"],
        date.fromisoformat(test_start) if test_start else row["test_start"],
    )
    if cutoffs.calibration_start >= cutoffs.test_start:
        raise ValueError("calibration_start must precede test_start")
    return cutoffs


def window_index(date_col: str, cutoffs: Cutoffs) -> Column:
    day = F.to_date(date_col)
    return (
        F.when(day >= F.lit(cutoffs.test_start), 2)
        .when(day >= F.lit(cutoffs.calibration_start), 1)
        .otherwise(0)
    )


def label_later_windows(df: DataFrame, index: str, parcel: str = "parcel_id") -> DataFrame:
    """Adds ``kept``: whether the row lies in the latest window its parcel appears in.

    The latest window per parcel comes from a map-side combined aggregate; the join back is
    split by adaptive execution when a parcel is hot.
    """
    latest = df.groupBy(parcel).agg(F.max(index).alias("_latest"))
    return join_on(df, latest, [parcel]).withColumn(
        "kept", F.col(index) == F.col("_latest")
    ).drop("_latest")


def chronological_split(df: DataFrame, date_col: str, cutoffs: Cutoffs,
                        parcel: str = "parcel_id") -> DataFrame:
    """Adds ``split`` and ``kept``; filter on ``kept`` for the purged partitions."""
    indexed = df.withColumn("_index", window_index(date_col, cutoffs))
    names = F.array(*[F.lit(name) for name in SPLITS])
    return (
        label_later_windows(indexed, "_index", parcel)
        .withColumn("split", F.element_at(names, F.col("_index") + 1))
        .drop("_index")
    )


def concat_partitions(df: DataFrame, *splits: str) -> DataFrame:
    return df.filter(F.col("split").isin(*splits) & F.col("kept"))


def reused_parcels(df: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    """Parcels present in more than one kept partition; must be empty."""
    return (
        df.filter("kept").groupBy(parcel).agg(F.count_distinct("split").alias("n_splits"))
        .filter(F.col("n_splits") > 1)
    )


def assert_disjoint(df: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    if reused_parcels(df, parcel).take(1):
        raise ValueError("a parcel appears in more than one partition")
    return df


def split_audit(df: DataFrame, parcel: str = "parcel_id") -> DataFrame:
    """Raw, kept and purged rows and parcels per window, with null parcels counted as one.

    Aggregating per parcel first keeps the distinct counts combinable.
    """
    per_parcel = df.groupBy("split", parcel).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("kept").alias("kept_rows"),
    )
    purged = F.col("rows") - F.col("kept_rows")
    return per_parcel.groupBy("split").agg(
        F.sum("rows").alias("raw_rows"),
        F.sum("kept_rows").alias("kept_rows"),
        F.count_if(F.col("kept_rows") > 0).alias("kept_parcels"),
        F.sum(purged).alias("purged_rows"),
        F.count_if(purged > 0).alias("purged_parcels"),
    )


def grouped_fraction(group: Column | str, seed: int) -> Column:
    """Uniform value in [0, 1) that depends only on the group and the seed."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(group) if isinstance(group, str) else group))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def grouped_split(df: DataFrame, group: Column | str, fraction: float, seed: int = 0) -> DataFrame:
    """Random calibration flag by group, so that no group crosses."""
    return df.withColumn("is_calibration", grouped_fraction(group, seed) < fraction)


def supported_operators(df: DataFrame, markets: tuple[str, str], minimum: int = 25) -> DataFrame:
    """Operators with enough rows in every required market; an absent market counts as zero."""
    counts = [F.count_if(F.col("market") == market).alias(f"n_{i}") for i, market in enumerate(markets)]
    return (
        df.groupBy("operator").agg(*counts)
        .withColumn("minimum_support", F.least("n_0", "n_1"))
        .filter(F.col("minimum_support") >= minimum)
    )


def keep_supported(df: DataFrame, supported: DataFrame) -> DataFrame:
    return df.join(F.broadcast(supported.select("operator")), "operator", "left_semi")  # one row per operator


def bucket_rare(df: DataFrame, training: DataFrame, category: str, minimum: int = 5,
                out: str = "bucket", label: str = "__rare__") -> DataFrame:
    """Category with enough training rows, or one shared label for the rare and unseen ones."""
    counts = training.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    frequent = counts.filter(F.col("_n") >= minimum)
    return df.join(frequent, category, "left").withColumn(
        out, F.when(F.col("_n").isNotNull(), F.col(category)).otherwise(F.lit(label))
    ).drop("_n")
