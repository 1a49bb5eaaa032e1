"""Row contracts as column expressions: each returns the list of violated rules."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that only exist after the outcome is known.
SALE_OUTCOMES = frozenset({
    "sale_price", "adjusted_sale_price", "nominal_price_per_sqft", "resale_price", "gross_spread",
    "gross_return",
})
EXIT_OUTCOMES = frozenset({
    "resale_date", "resale_price", "gross_spread", "gross_return", "hold_days", "duration_weeks",
    "event_observed",
})
# Names of simulated truths, and the fields of a home.
TRUTH_PREFIXES = ("true_", "truth_")
HOME_FIELDS = ("parcel_id", "sale_date", "sale_price", "living_area_sqft", "year_built")


def violations(*rules: tuple[Column, str]) -> Column:
    """Names of the rules whose condition is not known to hold."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(text)) for holds, text in rules
    ]))


def require_none(df: DataFrame, errors: str = "errors") -> DataFrame:
    """Strict mode: fail if any row violates its contract."""
    broken = df.filter(F.size(errors) > 0).take(1)
    if broken:
        raise ValueError(f"contract violated: {broken[0][errors]}")
    return df


def asof_violations(features: DataFrame, decision_at: Column | str) -> DataFrame:
    """Features that became available after the decision instant."""
    instant = F.lit(decision_at).cast("timestamp") if isinstance(decision_at, str) else decision_at
    return features.filter(F.col("available_at") > instant)


def require_asof(features: DataFrame, decision_at: Column | str) -> DataFrame:
    late = asof_violations(features, decision_at).take(1)
    if late:
        raise ValueError(f"feature {late[0]['name']!r} was not available at the decision time")
    return features


def values_as_of(features: DataFrame, decision_at: Column | str, seq: str = "seq", *,
                 strict: bool = True) -> DataFrame:
    """Value per entity and feature name, last duplicate wins.

    Strict mode rejects any feature from the future; otherwise those features are left out.
    """
    if strict:
        usable = require_asof(features, decision_at)
    else:
        instant = F.lit(decision_at).cast("timestamp") if isinstance(decision_at, str) else decision_at
        usable = features.filter(F.col("available_at") <= instant)
    return usable.groupBy("entity_id", "name").agg(F.max_by("value", seq).alias("value"))


def feature_map(values: DataFrame) -> DataFrame:
    """One map per entity; its size is the number of distinct feature names."""
    entries = F.map_from_entries(F.collect_list(F.struct("name", "value")))
    return values.groupBy("entity_id").agg(entries.alias("features"))


def home_contract(df: DataFrame) -> Column:
    current = F.year(F.current_date())
    present = [(F.col(f).isNotNull() if f in df.columns else F.lit(False), f"missing {f}")
               for f in HOME_FIELDS]
    return violations(
        *present,
        (F.col("sale_price") > 0, "sale_price must be positive"),
        (F.col("living_area_sqft") > 0, "living_area_sqft must be positive"),
        (F.col("year_built").between(F.lit(1800), current), "year_built outside supported range"),
    )


def request_violations(value: Column, repair: Column, weekly: Column, aversion: Column) -> Column:
    return violations(
        (value.between(100_000, 1_250_000), "value outside support"),
        (repair / value <= 0.20, "repair cost above 20% of value"),
        (weekly / value <= 0.01, "weekly holding cost above 1% of value"),
        (aversion <= 2.0, "risk aversion outside support"),
    )


def backtest_contract() -> Column:
    capital = F.col("capital_deployed")
    return violations(
        ((F.col("lead_id") != "") & (F.col("policy_name") != ""), "ids must be non-empty"),
        ((F.col("acquisition_offer") >= 0) & (F.col("sale_price") >= 0), "negative price"),
        ((F.col("weeks_held") >= 0) & (F.col("markdown_count") >= 0), "negative count"),
        (F.col("accepted") | ~F.col("sold"), "a rejected lead cannot be sold"),
        (capital.isNull() | (capital >= 0), "negative capital"),
    )


def effective_capital() -> Column:
    return F.when(
        F.col("accepted"), F.coalesce("capital_deployed", "acquisition_offer")
    ).otherwise(F.lit(0.0))


def leaking_features(features: Iterable[str], outcomes: frozenset[str] = SALE_OUTCOMES) -> list[str]:
    return sorted(f for f in features if f in outcomes or f.startswith(TRUTH_PREFIXES))


def guard_features(features: Sequence[str], outcomes: frozenset[str] = SALE_OUTCOMES) -> None:
    leaking = leaking_features(features, outcomes)
    if leaking:
        raise ValueError(f"features contain realized outcomes: {leaking}")
