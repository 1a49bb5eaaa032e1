"""Person-period expansion, administrative censoring and Kaplan-Meier estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homespell.operators.scale import Carried, exact_percentiles, join_on, order_groups, stacked, unstacked


def person_period(df: DataFrame, duration: str = "duration_weeks", event: str = "event_observed",
                  max_periods: int | None = None) -> DataFrame:
    """One row per unit and period at risk; the event falls in the last observed period.

    Durations above ``max_periods`` end there without an event.
    """
    if max_periods is not None and max_periods < 1:
        raise ValueError("max_periods must be positive")
    length = F.col(duration).cast("int")
    seen = length if max_periods is None else F.least(length, F.lit(max_periods))
    rows = df.filter(length >= 1).withColumn("period", F.explode(F.sequence(F.lit(1), seen)))
    return rows.withColumn(
        "event", (F.col(event).cast("boolean") & (F.col("period") == length)).cast("int")
    )


def survival_panel(df: DataFrame, duration: str, event: str) -> DataFrame:
    return person_period(df, duration, event).withColumn("at_risk", F.lit(1))


def horizon_grid(df: DataFrame, horizon: int) -> DataFrame:
    """Every unit in every period up to the horizon, whatever its own duration."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    return df.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def admin_censor(df: DataFrame, cutoff, *, strict: bool = True, keep_all: bool = False) -> DataFrame:
    """End follow-up at a cutoff; adds ``truncated`` and drops spells without a full week."""
    days = F.datediff(F.lit(cutoff).cast("date"), F.col("acquisition_date"))
    if strict and df.filter(F.coalesce(days, F.lit(0)) <= 0).take(1):
        raise ValueError("acquisitions must lie strictly before the follow-up cutoff")
    cut = F.col("hold_days") >= days
    outcomes = [c for c in ("resale_date", "resale_price", "gross_spread", "gross_return")
                if c in df.columns]
    censored = (
        df.withColumn("truncated", cut)
        .withColumns({
            "duration_weeks": F.when(cut, F.floor(days / 7).cast("int")).otherwise(
                F.col("duration_weeks")),
            "event_observed": F.col("event_observed") & ~cut,
            "hold_days": F.when(cut, days).otherwise(F.col("hold_days")),
            **{name: F.when(~cut, F.col(name)) for name in outcomes},
        })
    )
    if keep_all:
        return censored
    return censored.filter(F.col("event_observed") | (F.col("duration_weeks") >= 1))


def followup_audit(df: DataFrame, cutoff) -> DataFrame:
    """Latest exit seen before the cutoff, and how many spells were truncated or dropped."""
    censored = admin_censor(df, cutoff, keep_all=True)
    seen = F.col("event_observed")
    return censored.agg(
        F.max(F.when(seen, F.date_add("acquisition_date", F.col("hold_days")))).alias("latest_exit"),
        F.count_if("truncated").alias("truncated"),
        F.count_if(~seen & (F.col("duration_weeks") < 1)).alias("dropped"),
    )


def km_table(df: DataFrame, keys: Sequence[str], duration: str = "hold_days",
             event: str = "event_observed") -> DataFrame:
    """At-risk count, exits and survival at every distinct duration.

    Rows are first combined per (key, duration); the counts at risk and the product of the steps are then carried
    over ranges of (key, duration), so a key with many durations is not one task.
    """
    counts = df.groupBy(*keys, F.col(duration).alias("duration")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(event).cast("int")).alias("exits"),
    )
    at_risk = order_groups(counts, keys, ["duration"]).carry(at_risk=Carried("n", over="onward"))
    step = at_risk.add(_step=1 - F.col("exits") / F.col("at_risk"))
    return step.carry(survival=Carried("_step", "product")).result().drop("_step")


def km_estimates(df: DataFrame, keys: Sequence[str], horizons: Sequence[int] = (90, 120),
                 duration: str = "hold_days", event: str = "event_observed") -> DataFrame:
    """Exit probability by each horizon and the first time survival falls to one half."""
    steps = km_table(df, keys, duration, event)
    exited = F.col("exits") > 0
    return steps.groupBy(*keys).agg(
        F.min(F.when(exited & (F.col("survival") <= 0.5), F.col("duration")))
        .cast("double").alias("km_median_exit_days"),
        *[
            (1 - F.coalesce(F.min(F.when(exited & (F.col("duration") <= h), F.col("survival"))),
                            F.lit(1.0))).alias(f"km_exit_probability_{h}d")
            for h in horizons
        ],
    )


def km_curve(df: DataFrame, keys: Sequence[str], horizon_days: int = 365,
             duration: str = "hold_days", event: str = "event_observed") -> DataFrame:
    """Step curve of the exit probability by week, with its origin."""
    steps = km_table(df, keys, duration, event).filter(
        (F.col("exits") > 0) & (F.col("duration") <= horizon_days)
    )
    points = steps.select(*keys, (F.col("duration") / 7).alias("week"),
                          (1 - F.col("survival")).alias("exit_probability"))
    origin = df.select(*keys).distinct().select(
        *keys, F.lit(0.0).alias("week"), F.lit(0.0).alias("exit_probability")
    )
    return origin.unionByName(points)


def survival_curve(df: DataFrame, unit: Sequence[str], hazard: str = "hazard",
                   period: str = "period") -> DataFrame:
    """Running survival of each unit over its periods (at most one horizon per unit)."""
    window = Window.partitionBy(*unit).orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("survival", F.product(1 - F.col(hazard)).over(window))


def horizon_probability(df: DataFrame, unit: Sequence[str], hazard: str = "hazard") -> DataFrame:
    """Probability of an event within the scored periods."""
    return df.groupBy(*unit).agg((1 - F.product(1 - F.col(hazard))).alias("event_probability"))


def median_period(curve: DataFrame, unit: Sequence[str], max_period: int,
                  period: str = "period") -> DataFrame:
    """First period in which the event probability reaches one half, else one past the horizon."""
    reached = F.min(F.when(1 - F.col("survival") >= 0.5, F.col(period)))
    return curve.groupBy(*unit).agg(
        F.coalesce(reached, F.lit(max_period + 1)).cast("int").alias("median_period")
    )


def episode_summary(df: DataFrame, keys: Sequence[str] = ("market", "operator")) -> DataFrame:
    """Counts, exit shares, Kaplan-Meier estimates and medians per group; null keys are groups."""
    seen = F.col("event_observed").cast("boolean")
    parcels = df.groupBy(*keys, "parcel_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(seen).alias("exits"),
        F.min("acquisition_date").alias("first"),
        F.max("acquisition_date").alias("last"),
    )
    summary = parcels.groupBy(*keys).agg(
        F.sum("n").alias("n_acquisitions"),
        F.count(F.lit(1)).alias("n_unique_parcels"),
        F.sum("exits").alias("n_observed_exits"),
        (F.sum("exits") / F.sum("n")).alias("observed_exit_share"),
        F.min("first").alias("acquisition_start"),
        F.max("last").alias("acquisition_end"),
    )
    exits = df.filter(seen)
    medians = {"hold_days": "median_observed_hold_days"} | {
        name: f"median_{name}" for name in ("gross_spread", "gross_return") if name in df.columns}
    middle = exact_percentiles(stacked(exits, keys, medians), [*keys, "measure"], "value", {"middle": 0.5})
    for part in (unstacked(middle, keys, list(medians.values()), "middle"), km_estimates(df, keys)):
        summary = join_on(summary, part, list(keys))
    return summary
