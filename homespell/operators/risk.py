"""Weighted profit distributions in long form: (distribution keys, p, profit)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.operators.scale import (
    MASS_TOLERANCE,
    Carried,
    join_on,
    order_groups,
)


def _scale_of(total: Column) -> Column:
    """Divisor that leaves a mass alone when it already sums to one."""
    return F.when(F.abs(total - 1) <= MASS_TOLERANCE, F.lit(1.0)).otherwise(total)


def positive_mass(df: DataFrame) -> DataFrame:
    return df.filter(F.col("p") > 0)


def normalize_distribution(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop atoms without mass and rescale the rest to one per distribution."""
    atoms = positive_mass(df)
    totals = atoms.groupBy(*keys).agg(F.sum("p").alias("_total"))
    return join_on(atoms, totals, list(keys)).withColumn(
        "p", F.col("p") / _scale_of(F.col("_total"))
    ).drop("_total")


def expected_profit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and loss probability, both combined before the shuffle."""
    total = _scale_of(F.sum("p"))
    return positive_mass(df).groupBy(*keys).agg(
        (F.sum(F.col("p") * F.col("profit")) / total).alias("expected_profit"),
        (F.sum(F.when(F.col("profit") < 0, F.col("p")).otherwise(0.0)) / total)
        .alias("loss_probability"),
    )


def cumulative_mass(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``upto`` and ``start``: normalized mass up to and before each atom."""
    ranked = (
        order_groups(df, keys, order)
        .carry(_upto=Carried("p"), _total=Carried("p", over="all")).result()
    )
    scale = _scale_of(F.col("_total"))
    return ranked.withColumns({
        "upto": F.col("_upto") / scale,
        "start": (F.col("_upto") - F.col("p")) / scale,
        "p": F.col("p") / scale,
    }).drop("_upto", "_total")


def tail_statistics(df: DataFrame, keys: Sequence[str], *, alpha: float = 0.1,
                    quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """Expected positive loss and mean profit in the worst ``alpha`` mass, and quantiles.

    Atoms of equal profit are merged first: they are interchangeable in a tail.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    merged = positive_mass(df).groupBy(*keys, "profit").agg(F.sum("p").alias("p"))
    placed = cumulative_mass(merged, keys, ["profit"])
    tail = F.greatest(F.lit(0.0), F.least(F.col("upto"), F.lit(alpha)) - F.col("start"))
    profit = F.col("profit")
    return placed.groupBy(*keys).agg(
        (F.sum(tail * F.greatest(-profit, F.lit(0.0))) / alpha).alias("downside_cvar_loss"),
        (F.sum(tail * profit) / alpha).alias("lower_tail_mean"),
        *[
            F.coalesce(
                F.min(F.when(F.col("upto") + MASS_TOLERANCE >= q, profit)), F.max(profit)
            ).alias(name)
            for name, q in (quantiles or {}).items()
        ],
    )


def compress_distribution(df: DataFrame, keys: Sequence[str], max_points: int,
                          tie_break: Sequence[str] = ()) -> DataFrame:
    """At most ``max_points`` atoms of equal mass, each at the mean profit of its bin.

    An atom may be split over neighbouring bins. Smaller distributions stay as they are.
    """
    if max_points <= 0:
        raise ValueError("max_points must be positive")
    atoms = positive_mass(df).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = (
        order_groups(atoms, keys, ["profit", *tie_break])
        .carry(_upto=Carried("p"), _rank=Carried("_one"),
               _total=Carried("p", over="all"), _atoms=Carried("_one", over="all")).result()
    )
    scale = _scale_of(F.col("_total"))
    upto, start = F.col("_upto") / scale, (F.col("_upto") - F.col("p")) / scale
    first = F.floor(start * max_points + MASS_TOLERANCE)
    last = F.least(F.ceil(upto * max_points - MASS_TOLERANCE) - 1, F.lit(max_points - 1))
    small = F.col("_atoms") <= max_points
    bins = F.when(small, F.array(F.col("_rank") - 1)).otherwise(
        F.sequence(first, F.greatest(first, last))
    )
    placed = ranked.withColumns(
        {"_upto": upto, "_start": start, "_small": small, "_bins": bins}
    ).withColumn("bin", F.explode("_bins"))
    share = F.when(F.col("_small"), F.col("p") / scale).otherwise(
        F.least(F.col("_upto"), (F.col("bin") + 1) / max_points)
        - F.greatest(F.col("_start"), F.col("bin") / max_points)
    )
    return (
        placed.withColumn("_mass", share).filter(F.col("_mass") > MASS_TOLERANCE * 1e-3)
        .groupBy(*keys, "bin")
        .agg(F.sum("_mass").alias("p"),
             (F.sum(F.col("_mass") * F.col("profit")) / F.sum("_mass")).alias("profit"))
    )
