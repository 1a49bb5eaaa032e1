"""Scores of predictions, probabilities and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.operators.risk import tail_statistics
from homespell.operators.scale import (
    attach_row,
    exact_percentiles,
    join_on,
    order_groups,
    stacked,
    unstacked,
    weighted_quantiles,
)

PROBABILITY_CLIP = 1e-9
WEEKS_90_DAYS, WEEKS_120_DAYS = 13, 18


def group_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def numeric_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    middle = exact_percentiles(df, keys, value, {"median": 0.5, "p90": 0.9})
    top = df.groupBy(*keys).agg(F.max(value).alias("maximum"))
    return join_on(middle, top, list(keys))


def parcel_weights(df: DataFrame, parcel: str = "parcel_id", keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``weight``: every parcel has the same total, and the weights of a sample sum to one.

    Null parcels share one group. The counts come from combined aggregates and are joined back,
    so that adaptive execution can split the rows of a hot parcel.
    """
    counts = df.groupBy(*keys, parcel).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parcels"))
    per_parcel = (
        join_on(counts, sizes, list(keys)) if keys else attach_row(counts, sizes)
    )
    return join_on(df, per_parcel, [*keys, parcel]).withColumn(
        "weight", 1 / (F.col("_rows") * F.col("_parcels"))
    ).drop("_rows", "_parcels")


def weighted_means(df: DataFrame, keys: Sequence[str], *, actual: str = "sale_price",
                   prediction: str = "prediction", parcel: str = "parcel_id") -> DataFrame:
    """Parcel-weighted mean absolute error alone, without the ordered statistics."""
    error = F.abs(F.col(prediction) - F.col(actual))
    by_parcel = df.groupBy(*keys, parcel).agg(F.avg(error).alias("_ae"))
    return by_parcel.groupBy(*keys).agg(F.avg("_ae").alias("mean_absolute_error"))


def weighted_valuation_metrics(df: DataFrame, keys: Sequence[str] = (), *,
                               actual: str = "sale_price", prediction: str = "prediction",
                               parcel: str = "parcel_id", lower: str | None = "lower",
                               upper: str | None = "upper") -> DataFrame:
    """Parcel-weighted errors, coverage and weighted medians, one row per sample.

    A parcel-weighted mean is the mean over parcels of the parcel means, so every sum combines
    before the shuffle and no row needs its weight. Only the weighted medians do.
    """
    if (lower is None) != (upper is None):
        raise ValueError("give both interval bounds or neither")
    y, error = F.col(actual), F.col(prediction) - F.col(actual)
    scored = df.withColumns({
        "_ae": F.abs(error), "_se": error * error, "_pe": F.abs(error) / y, "_e": error,
        "_y": y, "_y2": y * y,
    })
    if lower:
        scored = scored.withColumns({
            "_covered": y.between(F.col(lower), F.col(upper)).cast("double"),
            "_width": F.col(upper) - F.col(lower),
        })
    means = ["_ae", "_se", "_pe", "_e", "_y", "_y2"] + (["_covered"] if lower else [])
    by_parcel = scored.groupBy(*keys, parcel).agg(
        F.count(F.lit(1)).alias("_rows"), *[F.avg(name).alias(name) for name in means]
    )
    pooled = by_parcel.groupBy(*keys).agg(
        F.sum("_rows").alias("n_transactions"),
        F.count(F.lit(1)).alias("n_parcels"),
        *[F.avg(name).alias(name) for name in means],
    )
    variance = F.col("_y2") - F.col("_y") * F.col("_y")
    result = pooled.select(
        *keys, "n_transactions", "n_parcels",
        F.col("_ae").alias("mean_absolute_error"),
        F.sqrt("_se").alias("root_mean_squared_error"),
        F.col("_pe").alias("mean_absolute_percentage_error"),
        F.col("_e").alias("mean_error"),
        F.when(variance > 0, 1 - F.col("_se") / variance).alias("weighted_r_squared"),
        *([F.least(F.greatest(F.col("_covered"), F.lit(0.0)), F.lit(1.0))
           .alias("interval_coverage")] if lower else []),
    )
    medians = {"_ae": "median_absolute_error", "_pe": "median_absolute_percentage_error"}
    if lower:
        medians["_width"] = "median_interval_width"
    # The medians share one ordered pass: a row per measure, keyed by it.
    weighted = parcel_weights(scored.select(*keys, parcel, *medians), parcel, keys)
    middle = unstacked(
        weighted_quantiles(stacked(weighted, keys, medians, "weight"), [*keys, "measure"], "value",
                           "weight", {"middle": 0.5}),
        keys, list(medians.values()), "middle")
    return join_on(result, middle, list(keys)) if keys else attach_row(result, middle)


def relative_gain(metrics: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One minus the ratio of mean absolute errors per sample."""
    other = baseline.select(*keys, F.col("mean_absolute_error").alias("_baseline"))
    return metrics.join(other, list(keys)).select(
        *keys, (1 - F.col("mean_absolute_error") / F.col("_baseline")).alias("relative_gain")
    )


def clipped(probability: Column | str, clip: float = PROBABILITY_CLIP) -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))


def squared_error(probability: Column, outcome: Column) -> Column:
    return (probability - outcome) * (probability - outcome)


def log_loss(probability: Column, outcome: Column) -> Column:
    p = clipped(probability)
    return -(outcome * F.ln(p) + (1 - outcome) * F.ln(1 - p))


def hazard_metrics(df: DataFrame, keys: Sequence[str] = (), *, probability: str = "hazard",
                   outcome: str = "event", training_rate: float | str = "training_rate",
                   episode: str | None = None, parcel: str | None = None) -> DataFrame:
    """Person-period scores against a constant hazard, in one pass.

    ``episode`` and ``parcel`` name the columns whose distinct values are counted as well.
    """
    p, y = clipped(probability), F.col(outcome).cast("double")
    base = F.col(training_rate) if isinstance(training_rate, str) else F.lit(training_rate)
    brier, baseline = F.avg(squared_error(p, y)), F.avg(squared_error(base, y))
    counted = [F.count_distinct(column).alias(name)
               for column, name in ((episode, "n_episodes"), (parcel, "n_parcels")) if column]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_risk_rows"),
        F.sum(F.col(outcome).cast("bigint")).alias("n_events_within_horizon"),
        *counted,
        brier.alias("person_period_brier_score"),
        baseline.alias("constant_hazard_brier_score"),
        F.when(baseline > 0, 1 - brier / baseline).alias("brier_skill_score"),
        F.avg(log_loss(F.col(probability), y)).alias("person_period_log_loss"),
        F.avg(y).alias("observed_person_period_hazard"),
        F.avg(p).alias("mean_predicted_person_period_hazard"),
    )


def roc_auc(df: DataFrame, keys: Sequence[str] = (), *, score: str = "hazard",
            outcome: str = "event") -> DataFrame:
    """Exact rank AUC with ties averaged; null with a single class.

    Scores are combined per distinct value, and one ordered pass counts the negatives below each.
    """
    y = F.col(outcome).cast("int")
    values = df.groupBy(*keys, F.col(score).alias("_score")).agg(
        F.sum(y).cast("double").alias("_pos"), F.sum(1 - y).cast("double").alias("_neg"))
    ranked = order_groups(values, keys, ["_score"]).running_sum("_neg", "_upto").result()
    wins = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, wins / pairs).alias("risk_row_auc"))


def period_rate(df: DataFrame, period: str = "period", outcome: str = "event") -> DataFrame:
    """Event rate per period; the pooled rate stands in the row with a null period."""
    rates = df.groupBy(period).agg(
        F.sum(outcome).alias("_events"), F.count(F.lit(1)).alias("_rows")
    )
    pooled = rates.agg(F.lit(None).cast(df.schema[period].dataType).alias(period),
                       (F.sum("_events") / F.sum("_rows")).alias("rate"))
    return rates.select(period, (F.col("_events") / F.col("_rows")).alias("rate")).unionByName(pooled)


def rate_lookup(df: DataFrame, rates: DataFrame, period: str = "period",
                out: str = "baseline") -> DataFrame:
    """Training rate of each row's period, or the pooled rate where the period is unknown."""
    small = rates
    pooled = small.filter(F.col(period).isNull()).select(F.col("rate").alias("_pooled"))
    known = small.filter(F.col(period).isNotNull()).withColumnRenamed("rate", out)
    joined = attach_row(df.join(known, period, "left"), pooled)
    return joined.withColumn(out, F.coalesce(out, "_pooled")).drop("_pooled")


def support_lookup(df: DataFrame, training: DataFrame, category: str,
                   out: str = "training_support") -> DataFrame:
    """Training count of each row's category; an unseen category counts zero."""
    counts = group_counts(training.filter(F.col(category).isNotNull()), [category], out)
    return df.join(counts, category, "left").withColumn(
        out, F.coalesce(out, F.lit(0)).cast("bigint")
    )


def binary_scores(df: DataFrame, keys: Sequence[str] = (), *, probability: str = "p",
                  outcome: str = "y", baseline: str = "baseline") -> DataFrame:
    """Brier score and log loss of a model and of its baseline rate."""
    p, y, b = F.col(probability), F.col(outcome).cast("double"), F.col(baseline)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(squared_error(p, y)).alias("brier_score"),
        F.avg(squared_error(b, y)).alias("baseline_brier"),
        F.avg(log_loss(p, y)).alias("log_loss"),
        F.avg(log_loss(b, y)).alias("baseline_log_loss"),
    )


def calibration_error(df: DataFrame, keys: Sequence[str] = (), *, probability: str = "p",
                      outcome: str = "y", bins: int = 10) -> DataFrame:
    """Share-weighted gap between mean prediction and mean outcome over equal-width bins."""
    p = F.col(probability)
    cell = F.least(F.floor(p * bins), F.lit(bins - 1))
    table = df.groupBy(*keys, cell.alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.abs(F.avg(p) - F.avg(F.col(outcome).cast("double"))).alias("_gap"),
    )
    return table.groupBy(*keys).agg(
        (F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("expected_calibration_error")
    )


def anchor_metrics(df: DataFrame, keys: Sequence[str], *, actual: str, prediction: str,
                   lower: str, upper: str, pooled: str) -> DataFrame:
    """Errors of a value anchor against the pooled median of the training sample."""
    y, p = F.col(actual), F.col(prediction)
    scored = df.withColumns({
        "_ae": F.abs(p - y), "_ape": F.abs(p - y) / y,
        "_naive": F.abs(y - F.col(pooled)),
        "_width": (F.col(upper) - F.col(lower)) / p,
    })
    result = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("evaluation_rows"),
        F.avg("_ae").alias("mean_absolute_error"),
        (F.sum("_ae") / F.sum(y)).alias("wape"),
        F.avg(y.between(F.col(lower), F.col(upper)).cast("double")).alias("interval_coverage"),
        F.avg("_naive").alias("pooled_median_baseline_mae"),
        (1 - F.avg("_ae") / F.avg("_naive")).alias("mae_improvement_over_pooled_median"),
    )
    medians = {"_ae": "median_absolute_error", "_ape": "median_absolute_percentage_error",
               "_width": "median_interval_width_rate"}
    middle = exact_percentiles(stacked(scored, keys, medians), [*keys, "measure"], "value", {"middle": 0.5})
    return join_on(result, unstacked(middle, keys, list(medians.values()), "middle"), list(keys))


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Population z-scores; a constant column gives zeros."""
    stats = df.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_sd_{c}") for c in columns],
    )
    joined = attach_row(df, stats)
    scaled = {
        f"{c}{suffix}": F.when(F.col(f"_sd_{c}") == 0, F.lit(0.0)).otherwise(
            (F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_sd_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*stats.columns)


def policy_scorecard(records: DataFrame, tail: float = 0.1, policy: str = "policy_name") -> DataFrame:
    """Lead-level metrics of each policy."""
    accepted = F.col("accepted")
    sold = accepted & F.col("sold")
    weeks, profit = F.col("weeks_held"), F.col("profit")
    n, n_accepted, n_sold = F.count(F.lit(1)), F.count_if(accepted), F.count_if(sold)
    capital = F.coalesce(F.col("capital_deployed"), F.col("acquisition_offer"))

    def rate(count: Column) -> Column:
        return F.when(n_accepted > 0, count / n_accepted).otherwise(F.lit(0.0))

    def per_accepted(total: Column) -> Column:
        return F.when(n_accepted > 0, total / n_accepted).otherwise(F.lit(0.0))

    accepted_profit = F.coalesce(F.sum(F.when(accepted, profit)), F.lit(0.0))
    revenue = F.coalesce(F.sum(F.when(sold, F.col("sale_price"))), F.lit(0.0))
    capital_days = F.coalesce(F.sum(F.when(accepted, capital * weeks * 7)), F.lit(0.0))
    margin = F.when(revenue != 0, accepted_profit / revenue).otherwise(F.lit(0.0))
    card = records.groupBy(policy).agg(
        n.alias("n_leads"), n_accepted.alias("n_accepted"), n_sold.alias("n_sold"),
        (n_accepted / n).alias("acceptance_rate"),
        rate(n_sold).alias("sell_through_rate"),
        rate(F.count_if(sold & (weeks <= WEEKS_90_DAYS))).alias("sell_through_90d"),
        rate(F.count_if(sold & (weeks <= WEEKS_120_DAYS))).alias("sell_through_120d"),
        F.avg(profit).alias("mean_profit_per_lead"),
        per_accepted(accepted_profit).alias("mean_profit_per_accepted_home"),
        margin.alias("contribution_margin"),
        (margin * 10_000).alias("contribution_margin_bps"),
        rate(F.count_if(accepted & (profit < 0))).alias("loss_rate"),
        capital_days.alias("total_capital_days"),
        per_accepted(capital_days).alias("mean_capital_days_per_accepted_home"),
        per_accepted(F.coalesce(F.sum(F.when(accepted, F.col("markdown_count"))), F.lit(0)))
        .alias("mean_markdowns_per_accepted_home"),
    )
    held = exact_percentiles(records.filter(accepted), [policy], "weeks_held",
                             {"median_weeks_held": 0.5})
    tails = tail_statistics(
        records.select(policy, F.lit(1.0).alias("p"), "profit"), [policy], alpha=tail,
        quantiles={"p10_profit": 0.1},
    ).select(policy, "downside_cvar_loss", "p10_profit")
    return (
        card.join(held, policy, "left").join(tails, policy, "left")
        .withColumn("median_weeks_held", F.coalesce("median_weeks_held", F.lit(0.0)))
    )


# Compared metric and the name of its change.
LIFTS = {
    "mean_profit_per_lead": "profit_per_lead_lift",
    "contribution_margin_bps": "contribution_margin_bps_lift",
    "acceptance_rate": "acceptance_rate_lift",
    "sell_through_rate": "sell_through_rate_lift",
    "median_weeks_held": "median_weeks_held_change",
    "loss_rate": "loss_rate_change",
    "downside_cvar_loss": "downside_cvar_loss_change",
}


def compare_to_baseline(card: DataFrame, baseline: str, policy: str = "policy_name") -> DataFrame:
    """Candidate minus baseline for every other policy."""
    base = card.filter(F.col(policy) == baseline).select(
        F.col(policy).alias("baseline_name"), *[F.col(m).alias(f"_base_{m}") for m in LIFTS]
    )
    return attach_row(card.filter(F.col(policy) != baseline), base).select(
        policy, "baseline_name",
        *[(F.col(m) - F.col(f"_base_{m}")).alias(name) for m, name in LIFTS.items()],
    )
