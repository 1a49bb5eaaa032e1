"""Column functions for offers, list prices, demand and profit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from homespell.functions.scalars import as_column

# The four weekly price actions in tie-breaking order.
ACTIONS = (("hold", 0.0), ("cut_1_pct", 0.01), ("cut_2_5_pct", 0.025), ("cut_5_pct", 0.05))
# Supports of the randomized treatments.
OFFER_RATIO_SUPPORT = (0.82, 1.02)
LIST_PREMIUM_SUPPORT = (-0.30, 0.15)
SUPPORT_TOLERANCE = 1e-9
_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two halves


@dataclass(frozen=True)
class Scenario:
    name: str
    probability: float
    value_multiplier: float = 1.0
    demand_multiplier: float = 1.0


def cents(value: Column | str) -> Column:
    """Integer cents nearest to a double; a tie in the binary value goes to the even cent.

    Decimal rounding of the printed value differs from this on about one price in forty for the
    2.5% cut, so the distance to the half cent is taken exactly from the two halves of the
    nearest double to it.
    """
    x = as_column(value)
    low = F.floor(x * 100)
    half = (low + 0.5) / 100
    scaled = half * _SPLITTER
    high_part = scaled - (scaled - half)
    low_part = half - high_part
    # Exact value of (nearest double to the half cent) * 200 - (odd integer).
    offset = (high_part * 200 - (low * 2 + 1)) + low_part * 200
    up = (
        F.when(x > half, 1).when(x < half, 0).when(offset > 0, 1).when(offset < 0, 0)
        .otherwise(F.pmod(low, F.lit(2)))
    )
    return (low + up).cast("bigint")


def round_cents(value: Column | str) -> Column:
    return cents(value) / 100.0


def price_after(price: Column | str, cut: Column | float) -> Column:
    return round_cents(as_column(price) * (F.lit(1.0) - cut))


def action_table() -> list[tuple[str, int, float]]:
    return [(name, order, cut) for order, (name, cut) in enumerate(ACTIONS)]


def contribution_profit(sale_price, offer, repair, acquisition, fixed, rate, prelisting, week,
                        weekly) -> Column:
    """Profit of a sale in a zero-based listing week, after all declared costs."""
    price = as_column(sale_price)
    held = as_column(prelisting) + as_column(week) + 1
    return (
        price - as_column(offer) - as_column(repair) - as_column(acquisition)
        - (as_column(fixed) + as_column(rate) * price)
        - held * as_column(weekly)
    )


def sigmoid(value: Column) -> Column:
    return F.when(value >= 0, 1 / (1 + F.exp(-value))).otherwise(
        F.exp(value) / (1 + F.exp(value))
    )


def logit(probability: Column | float, clip: float = 1e-8) -> Column:
    p = F.lit(probability) if isinstance(probability, float) else probability
    clipped = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(clipped / (1 - clipped))


def elasticity_scenarios(reference: Column, price: Column, week: Column, *, base_probability,
                         elasticity, dom_per_week=0.0, negotiation_discount=0.005, shift=0.0,
                         scenarios: Sequence[Scenario] = (Scenario("base", 1.0),)) -> Column:
    """Array of (name, probability, sale_probability, sale_price), one element per scenario."""
    def number(value):
        return value if isinstance(value, Column) else F.lit(float(value))

    elements = []
    for scenario in scenarios:
        value = reference * scenario.value_multiplier
        log_odds = (
            logit(number(base_probability))
            - number(elasticity) * (price / value - 1)
            + number(dom_per_week) * week
            + F.ln(F.lit(scenario.demand_multiplier))
            + number(shift)
        )
        elements.append(
            F.struct(
                F.lit(scenario.name).alias("name"),
                F.lit(scenario.probability).alias("probability"),
                sigmoid(log_odds).alias("sale_probability"),
                F.least(price * (1 - number(negotiation_discount)), value).alias("sale_price"),
            )
        )
    return F.array(*elements)


def logistic_acceptance(offer: Column, reference: Column, *, midpoint=0.92, slope=30.0,
                        intercept=0.0, urgency: Column | float = 0.0) -> Column:
    urgency_log_odds = urgency if isinstance(urgency, Column) else F.lit(float(urgency))
    return sigmoid(F.lit(intercept) + urgency_log_odds + slope * (offer / reference - midpoint))


def fixed_spread_offer(reference: Column | str, spread: float = 0.08) -> Column:
    if not 0 <= spread < 1:
        raise ValueError("spread must be in [0, 1)")
    return round_cents(as_column(reference) * F.lit(1.0 - spread))


def scheduled_action(week: Column | str, action: str = "cut_2_5_pct", every: int = 2,
                     first_week: int = 2) -> Column:
    """Action of a markdown calendar: hold, then cut on a fixed cadence."""
    w = as_column(week)
    if action == "hold" or every <= 0 or first_week < 0:
        raise ValueError("a markdown calendar needs a cut, a positive cadence and a first week")
    due = (w >= first_week) & ((w - first_week) % every == 0)
    return F.when(due, F.lit(action)).otherwise(F.lit("hold"))


def stress_scenarios(lower: Column, point: Column, upper: Column,
                     design: Sequence[tuple[str, float]]) -> Column:
    """Three weighted resale values from a prediction interval, ordered around the point."""
    values = (F.least(lower, point), point, F.greatest(upper, point))
    return F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(weight).alias("probability"),
                     value.alias("resale_value"))
            for (name, weight), value in zip(design, values, strict=True)
        ]
    )


def stressed_proceeds(price: Column, resale_value: Column, negotiation_discount=0.005) -> Column:
    return F.least(price * (1 - negotiation_discount), resale_value)


def offer_ratio_supported(ratio: Column, support=OFFER_RATIO_SUPPORT) -> Column:
    return ratio.between(*support)


def list_premium(price: Column, reference: Column, support=LIST_PREMIUM_SUPPORT):
    """Premium clamped into its support, and whether it was inside within the tolerance."""
    low, high = support
    raw = price / reference - 1
    inside = raw.between(low - SUPPORT_TOLERANCE, high + SUPPORT_TOLERANCE)
    return F.least(F.greatest(raw, F.lit(low)), F.lit(high)), inside
