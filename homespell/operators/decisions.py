"""Batch pricing decisions: a table of leads in, a table of decisions out.

Everything about one lead (weekly prices, demand scenarios, profit atoms) has a fixed small size,
so it lives in arrays on the lead's row. The jobs below are therefore map-only over leads: they
need no shuffle, and no lead can be hot. A distribution of more atoms than the declared limit is
folded into bins of equal mass. The dynamic program over prices is in ``markdown``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.functions import contracts as C
from homespell.functions import pricing as P
from homespell.functions.pricing import ACTIONS
from homespell.operators.metrics import zscores

ATOMS = "array<struct<profit:double,p:double>>"
TIE = 1e-9
CENTS_PATH = "array<bigint>"
SaleModel = Callable[[Column, Column, Column], tuple[Column, Column]]


@dataclass(frozen=True)
class PricingConfig:
    horizon_weeks: int = 17
    tail_probability: float = 0.1
    min_list_price_ratio: float = 0.70
    max_distribution_points: int = 200

    def check(self) -> None:
        if self.horizon_weeks <= 0 or not 0 < self.tail_probability <= 1 or self.max_distribution_points <= 0:
            raise ValueError("horizon, tail probability and distribution points must be positive")


def elasticity_model(price: Column, week: Column, scenario: Column) -> tuple[Column, Column]:
    """Weekly sale probability and proceeds of one scenario, from the lead's demand columns."""
    value = F.col("reference") * scenario["value_multiplier"]
    log_odds = (
        P.logit(F.col("base_probability"))
        - F.col("elasticity") * (price / value - 1)
        + F.col("dom_per_week") * week
        + F.ln(scenario["demand_multiplier"])
        + F.col("demand_shift")
    )
    proceeds = F.least(price * (1 - F.col("negotiation_discount")), value)
    return bind(log_odds, P.sigmoid), proceeds


def fitted_model(price: Column, week: Column, scenario: Column) -> tuple[Column, Column]:
    """The same from a fitted hazard: lead score, price effect and one effect per week."""
    premium, _ = P.list_premium(price, F.col("prelisting_reference"))
    log_odds = (
        F.col("hazard_score") + F.col("premium_effect") * premium
        + F.element_at("week_effects", (week + 1).cast("int"))
    )
    proceeds = F.least(price * (1 - F.col("negotiation_discount")), scenario["resale_value"])
    return bind(log_odds, P.sigmoid), proceeds


def _profit(sale_price: Column, week: Column) -> Column:
    return P.contribution_profit(
        sale_price, "offer", "repair_cost", "acquisition_cost", "fixed_cost", "cost_rate",
        "prelisting_weeks", week, "weekly_holding_cost",
    )


def _weights() -> Column:
    """Scenarios with positive weight, rescaled to one."""
    kept = F.filter("scenarios", lambda s: s["probability"] > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, s: acc + s["probability"])
    scale = F.when(F.abs(total - 1) <= TIE, F.lit(1.0)).otherwise(total)
    return F.transform(kept, lambda s: s.withField("probability", s["probability"] / scale))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mean_of(atoms: Column) -> Column:
    return F.aggregate(atoms, F.lit(0.0), lambda acc, a: acc + a["p"] * a["profit"])


def loss_probability_of(atoms: Column) -> Column:
    return F.aggregate(atoms, F.lit(0.0), lambda acc, a: acc + F.when(a["profit"] < 0, a["p"]).otherwise(0.0))


def cvar_of(atoms: Column, alpha: float) -> Column:
    """Expected positive loss in the worst ``alpha`` mass of an atom array."""
    start = F.struct(F.lit(alpha).alias("left"), F.lit(0.0).alias("loss"))

    def take(acc: Column, atom: Column) -> Column:
        mass = F.least(atom["p"], acc["left"])
        return F.struct(
            (acc["left"] - mass).alias("left"),
            (acc["loss"] + mass * F.greatest(-atom["profit"], F.lit(0.0))).alias("loss"),
        )

    return F.aggregate(F.sort_array(atoms), start, take, lambda acc: acc["loss"] / alpha)


def _atom(profit: Column, mass: Column) -> Column:
    return F.struct(profit.alias("profit"), mass.alias("p"))


def price_path(df: DataFrame, cuts: Column, out: str = "path") -> DataFrame:
    """Weekly list prices in cents under fixed cut fractions, rounded again every week."""
    def step(acc: Column, cut: Column) -> Column:
        last = F.when(F.size(acc) == 0, F.col("list_price")).otherwise(F.element_at(acc, -1) / 100.0)
        return F.concat(acc, F.array(bind(last * (1.0 - cut), P.cents)))

    empty = F.array().cast(CENTS_PATH)
    return df.withColumn(out, F.aggregate(cuts, empty, lambda acc, cut: step(acc, cut).cast(CENTS_PATH)))


def scheduled_cuts(horizon: int, action: str = "cut_2_5_pct", every: int = 2,
                   first_week: int = 2) -> Column:
    """Cut fraction of every week under a markdown calendar."""
    cut = dict(ACTIONS)[action]
    weeks = F.sequence(F.lit(0), F.lit(horizon - 1))
    return F.transform(weeks, lambda w: F.when(
        P.scheduled_action(w, action, every, first_week) == "hold", F.lit(0.0)
    ).otherwise(F.lit(cut)))


def hold_cuts(horizon: int) -> Column:
    return F.array_repeat(F.lit(0.0), horizon)


def compress_atoms(atoms: Column, points: int) -> Column:
    """The atoms, or where they are more than ``points`` as many bins of equal mass at their mean profits."""
    kind = "array<struct<profit:double,p:double,start:double>>"

    def place(acc: Column, atom: Column) -> Column:
        last = F.element_at(acc, -1)
        start = F.when(F.size(acc) == 0, F.lit(0.0)).otherwise(last["start"] + last["p"])
        return F.concat(acc, F.array(F.struct(atom["profit"], atom["p"], start.alias("start")))).cast(kind)

    def binned(placed: Column, total: Column) -> Column:
        def one(index: Column) -> Column:
            low, high = total * index / points, total * (index + 1) / points

            def add(acc: Column, a: Column) -> Column:
                share = F.greatest(F.lit(0.0), F.least(a["start"] + a["p"], high) - F.greatest(a["start"], low))
                return acc + share * a["profit"]

            return _atom(F.aggregate(placed, F.lit(0.0), add) * points / total, total / points)

        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), one)

    ordered = F.array_sort(F.filter(atoms, lambda a: a["p"] > 0))
    mass = F.aggregate(atoms, F.lit(0.0), lambda acc, a: acc + a["p"])
    folded = bind(F.aggregate(ordered, F.array().cast(kind), place), lambda placed: bind(mass, lambda total: binned(placed, total)))
    return F.when(F.size(atoms) <= points, atoms).otherwise(folded)


def policy_outcomes(leads: DataFrame, cuts: Column, config: PricingConfig, *,
                    model: SaleModel = elasticity_model) -> DataFrame:
    """The part of ``evaluate_policy`` that no offer changes: ``path``, ``sale_by_horizon``, ``feasible`` and ``_sales``.

    Worked out before the offers of a lead become rows, it is worked out once a lead. ``_sales`` holds price, week and
    probability of each sale, the liquidation last. Each week's outcomes are looked at once.
    """
    config.check()
    last = config.horizon_weeks - 1
    priced = price_path(leads.withColumn("scenarios", _weights()), cuts)

    def week_outcomes(cents: Column, week: Column) -> Column:
        def outcome(s: Column) -> Column:
            chance, proceeds = model(cents / 100.0, week, s)
            return F.struct(s["probability"].alias("q"), chance.alias("h"), proceeds.alias("proceeds"))
        return F.transform("scenarios", outcome)

    def unsold(acc: Column, week: Column) -> Column:
        sold = F.aggregate(week, F.lit(0.0), lambda total, o: total + o["q"] * o["h"])
        return F.concat(acc, F.array(F.element_at(acc, -1) * F.greatest(F.lit(0.0), 1 - sold)))

    def sale(price: Column, week: Column, mass: Column) -> Column:
        return F.struct(price.alias("price"), week.cast("int").alias("week"), mass.alias("p"))

    # The chance that the home is still there: before each week, and after the last one.
    alive = F.aggregate("_weeks", F.array(F.lit(1.0)).cast("array<double>"), lambda acc, week: unsold(acc, week).cast("array<double>"))
    priced = priced.withColumn("_weeks", F.transform("path", lambda c, w: week_outcomes(c, w))).withColumn("_alive", alive)
    sold = F.flatten(F.transform("_weeks", lambda week, w: bind(F.get("_alive", w), lambda left: F.transform(
        week, lambda o: sale(o["proceeds"], w, left * o["q"] * o["h"])))))
    liquidated = bind(F.element_at(F.slice("_alive", 1, last + 1), -1), lambda left: F.transform(
        F.element_at("_weeks", -1),
        lambda o: sale(o["proceeds"] * F.col("liquidation_discount"), F.size("path") - 1, left * o["q"] * (1 - o["h"]))))
    floor = F.col("prelisting_reference") * config.min_list_price_ratio
    prices = F.concat(F.array(P.cents("list_price")), F.col("path"))
    falls = F.exists(F.sequence(F.lit(1), F.lit(config.horizon_weeks)), lambda i: (
        F.element_at(prices, i + 1) < F.element_at(prices, i)
    ) & (F.element_at(prices, i + 1) / 100.0 < floor))
    return priced.withColumns({
        "_sales": F.filter(F.concat(sold, liquidated), lambda s: s["p"] > 0),
        "sale_by_horizon": 1 - F.element_at("_alive", -1), "feasible": ~falls,
    }).drop("_weeks", "_alive")


def evaluate_policy(leads: DataFrame, cuts: Column, config: PricingConfig, *,
                    model: SaleModel = elasticity_model) -> DataFrame:
    """Profit distribution of a fixed markdown policy with liquidation at the horizon.

    Adds ``atoms``, ``expected_profit``, ``downside_cvar_loss``, ``objective``,
    ``sale_by_horizon`` and ``feasible`` (no cut goes below the markdown floor). Rows that carry their
    ``policy_outcomes`` of the same policy already keep these.
    """
    config.check()
    sold = leads if "_sales" in leads.columns else policy_outcomes(leads, cuts, config, model=model)
    atoms = F.transform("_sales", lambda s: _atom(_profit(s["price"], s["week"]), s["p"]))
    done = sold.withColumn("atoms", atoms).drop("_sales")
    done = done.withColumn("atoms", compress_atoms(F.col("atoms"), config.max_distribution_points))
    return score_atoms(done, config.tail_probability)


def score_atoms(df: DataFrame, alpha: float) -> DataFrame:
    """Mean, tail loss and risk-adjusted objective of the ``atoms`` array."""
    return df.withColumns({
        "expected_profit": mean_of(F.col("atoms")),
        "downside_cvar_loss": cvar_of(F.col("atoms"), alpha),
    }).withColumn(
        "objective", F.col("expected_profit") - F.col("risk_aversion") * F.col("downside_cvar_loss")
    )


def quote(df: DataFrame, acceptance: str = "acceptance", alpha: float = 0.1,
          quote_cost: float = 0.0) -> DataFrame:
    """Lead-level distribution of an offer: accepted branch, rejected branch, cost of quoting.

    The exit distribution stays available as ``exit_expected_profit`` and ``exit_atoms``.
    """
    accepted = F.transform("atoms", lambda a: _atom(a["profit"] - quote_cost, a["p"] * F.col(acceptance)))
    rejected = F.array(_atom(F.lit(-quote_cost), 1 - F.col(acceptance)))
    mixed = F.filter(F.concat(accepted, rejected), lambda a: a["p"] > 0)
    renamed = df.withColumns({
        "exit_expected_profit": F.col("expected_profit"), "exit_atoms": F.col("atoms"),
    }).withColumn("atoms", mixed)
    return score_atoms(renamed, alpha).withColumn("loss_probability", loss_probability_of(F.col("atoms")))


def best_offer(candidates: DataFrame, lead: str) -> DataFrame:
    """Candidate with the largest (objective, expected profit, -offer) per lead."""
    rest = [c for c in candidates.columns if c != lead]
    rank = F.struct("objective", "expected_profit", (-F.col("offer")).alias("_cheap"))
    return candidates.groupBy(lead).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(lead, "b.*")


def target_acceptance_offer(grid: Column, acceptance: Callable[[Column], Column],
                            target: float = 0.5) -> Column:
    """Smallest grid offer that reaches the target acceptance, else the largest."""
    ordered = F.array_sort(F.array_distinct(grid))
    enough = F.filter(ordered, lambda offer: acceptance(offer) >= target)
    return F.coalesce(F.get(enough, F.lit(0)), F.element_at(ordered, -1))


def first_best(candidates: Column, objective: Callable[[Column], Column], kind: str) -> Column:
    """First candidate that beats its predecessors by more than the tie tolerance."""
    return F.aggregate(
        candidates, F.lit(None).cast(kind),
        lambda best, c: F.when(best.isNull() | (objective(c) > objective(best) + TIE), c)
        .otherwise(best).cast(kind),
    )


def feasible_cents(cents: Column, floor: Column, supported: Callable[[Column], Column] | None = None
                   ) -> Column:
    """Actions open at a price: (action, cents), holding always and cuts down to the floor."""
    def option(name: str, cut: float) -> Column:
        after = bind(cents / 100.0 * (1.0 - cut), P.cents)
        allowed = F.lit(True) if name == "hold" else after / 100.0 >= floor
        if supported is not None:
            allowed = allowed & supported(after / 100.0)
        return F.when(allowed, F.struct(F.lit(name).alias("action"), after.alias("cents")))

    return F.array_compact(F.array(*[option(name, cut) for name, cut in ACTIONS]))


def decision_table(solved: DataFrame, *keys: str) -> DataFrame:
    return solved.select(*keys, F.inline("decisions"))


def sale_on_path(path: Column) -> Column:
    """Chance of a sale along a no-sale path."""
    return 1 - F.aggregate(path, F.lit(1.0), lambda acc, d: acc * (1 - d["sale_probability"]))


# ------------------------------------------------------------------------------ request handling

_TEMPLATE_FIELDS = (
    "name", "template_reference", "demand_shift", "urgency", "template_weekly", "cost_rate",
    "template_fixed", "template_acquisition", "prelisting_weeks", "template_list_price",
    "offer_grid", "base_probability", "elasticity", "dom_per_week", "midpoint", "slope",
    "intercept", "template_aversion", "liquidation_discount", "scenarios",
)

# The three declared worked cases, in the order of the fields above; scenarios are
# (name, weight, value multiplier, demand multiplier).
CASES = (
    ("healthy-demand-margin-protection", 400_000.0, 0.35, 0.0, 650.0, 0.035, 1_500.0, 2_000.0, 2,
     410_000.0, (348_000.0, 356_000.0, 364_000.0, 372_000.0, 380_000.0), 0.22, 8.0, 0.02, 0.91,
     28.0, 0.0, 0.20, 0.94,
     (("soft", 0.20, 0.97, 0.80), ("base", 0.60, 1.00, 1.00), ("strong", 0.20, 1.03, 1.20))),
    ("stale-inventory-high-carry", 600_000.0, -0.30, 0.0, 1_800.0, 0.04, 2_000.0, 3_000.0, 3,
     645_000.0, (510_000.0, 525_000.0, 540_000.0, 555_000.0, 570_000.0), 0.09, 14.0, -0.01, 0.90,
     26.0, 0.10, 0.45, 0.90,
     (("soft", 0.35, 0.94, 0.65), ("base", 0.50, 0.98, 0.90), ("rebound", 0.15, 1.02, 1.10))),
    ("sparse-support-downside-protection", 325_000.0, -0.10, 0.15, 900.0, 0.04, 1_250.0, 2_250.0, 2,
     338_000.0, (266_500.0, 276_250.0, 286_000.0, 295_750.0, 305_500.0), 0.14, 10.0, 0.0, 0.89,
     24.0, 0.0, 0.90, 0.88,
     (("downside", 0.30, 0.86, 0.55), ("base", 0.50, 1.00, 1.00), ("upside", 0.20, 1.08, 1.20))),
)
CASE_SCENARIOS = 3
MAX_WIDTH_RATE = 0.20


def _scenario_array(scenarios: Sequence[tuple]) -> Column:
    names = ("name", "probability", "value_multiplier", "demand_multiplier")
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in scenarios
    ])


def case_templates() -> Column:
    """The worked cases as an array of structs that rides along on each request row."""
    rows = []
    for case in CASES:
        fields = []
        for name, value in zip(_TEMPLATE_FIELDS, case, strict=True):
            if name == "scenarios":
                column = _scenario_array(value)
            elif name == "offer_grid":
                column = F.array(*[F.lit(v) for v in value])
            else:
                column = F.lit(value)
            fields.append(column.alias(name))
        rows.append(F.struct(*fields))
    return F.array(*rows)


def nearest_template(value: Column, templates: Column | None = None) -> Column:
    """Template closest in log value, ties by name."""
    ranked = F.transform(templates if templates is not None else case_templates(), lambda t: F.struct(
        F.abs(F.ln(value / t["template_reference"])).alias("distance"), t["name"].alias("name"),
        t.alias("template")))
    return F.array_min(ranked)["template"]


def adapt_requests(requests: DataFrame) -> DataFrame:
    """Nearest worked case rescaled to each request: grid, list price and costs in its support."""
    matched = requests.withColumn("_t", nearest_template(F.col("value")))
    kept = [c for c in requests.columns]
    named = matched.select(*kept, *[F.col(f"_t.{n}").alias("case_name" if n == "name" else n)
                                    for n in _TEMPLATE_FIELDS])
    scale = F.col("value") / F.col("template_reference")
    low, high = P.OFFER_RATIO_SUPPORT

    def offer(template_offer: Column) -> Column:
        rounded = P.round_cents(F.col("value") * (template_offer / F.col("template_reference")))
        ratio = rounded / F.col("value")
        return F.when(ratio < low, F.col("value") * low).when(
            ratio > high, F.col("value") * high).otherwise(rounded)

    return named.withColumns({
        "reference": F.col("value"),
        "prelisting_reference": F.col("value"),
        "offers": F.transform("offer_grid", offer),
        "list_price": F.col("value") * (F.col("template_list_price") / F.col("template_reference")),
        "fixed_cost": F.col("template_fixed") * scale,
        "acquisition_cost": F.col("template_acquisition") * scale,
        "negotiation_discount": F.lit(0.005),
        "interval_width": F.array_max(F.transform("scenarios", lambda s: s["value_multiplier"]))
        - F.array_min(F.transform("scenarios", lambda s: s["value_multiplier"])),
    }).drop("offer_grid", "template_weekly", "template_aversion", "template_list_price",
            "template_fixed", "template_acquisition")


def explode_offers(adapted: DataFrame) -> DataFrame:
    """One row per distinct offer of the grid, with its acceptance probability."""
    rows = adapted.withColumn("offer", F.explode(F.array_distinct("offers"))).drop("offers")
    ratio = F.col("offer") / F.col("reference")
    return rows.withColumn("acceptance", P.sigmoid(
        F.col("intercept") + F.col("urgency") + F.col("slope") * (ratio - F.col("midpoint"))))


def recommend(best: DataFrame, requests: DataFrame, lead: str = "property_id") -> DataFrame:
    """Review, abstain or price, with the reason of the first gate that applies.

    Where ``best`` has a ``no_sale_path``, ``policy`` lists its weeks for priced requests and is empty for others.
    """
    paths = [c for c in ("no_sale_path",) if c in best.columns]
    solved = best.select(lead, "offer", "objective", "expected_profit", "exit_expected_profit",
                         "loss_probability", "sale_by_horizon", *paths)
    rows = requests.join(solved, lead, "left")
    outside = F.size("violations") > 0
    wide = F.col("interval_width") > MAX_WIDTH_RATE
    worthless = F.col("objective") <= 0
    thin = F.col("exit_expected_profit") / F.col("offer") < F.col("target_margin")
    gated = rows.withColumns({
        "recommendation": F.when(outside, "review").when(wide | worthless, "abstain")
        .when(thin, "review").otherwise("price"),
        "reason": F.when(outside, F.concat_ws("; ", "violations"))
        .when(wide, "scenario interval too wide").when(worthless, "non-positive value")
        .when(thin, "margin below target").otherwise("priced"),
    })
    priced = F.col("recommendation") == "price"
    if paths:
        weekly = F.transform("no_sale_path", lambda d: F.struct(
            d["week"].alias("week"), d["action"].alias("action"), F.round(d["cents"] / 100.0, 2).alias("list_price"),
            F.round(d["sale_probability"], 6).alias("sale_probability")))
        gated = gated.withColumn("policy", F.when(priced, weekly).otherwise(F.slice(weekly, 1, 0))).withColumn(
            "policy", F.coalesce("policy", F.array().cast("array<struct<week:int,action:string,list_price:double,sale_probability:double>>")))
    return gated.withColumns({
        "acquisition_offer": F.when(priced, P.round_cents("offer")),
        "expected_profit": F.when(priced, F.round("expected_profit", 2)).otherwise(0.0),
        "probability_of_loss": F.when(priced, F.round("loss_probability", 6)).otherwise(0.0),
        "sale_by_120_days": F.when(priced, F.round("sale_by_horizon", 6)).otherwise(0.0),
    })


def request_gate(requests: DataFrame, solver: Callable[[DataFrame], DataFrame],
                 lead: str = "property_id", ahead: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Price a table of requests; only rows inside the supports are solved.

    ``ahead`` is done once a request, before its offers become the rows that ``solver`` gets.
    """
    checked = adapt_requests(requests.withColumn("violations", C.request_violations(
        F.col("value"), F.col("repair_cost"), F.col("weekly_holding_cost"), F.col("risk_aversion"))))
    solvable = checked.filter(
        (F.size("violations") == 0) & (F.col("interval_width") <= MAX_WIDTH_RATE))
    quoted = quote(solver(explode_offers(ahead(solvable) if ahead else solvable)))
    told = [c for c in (lead, "offer", "objective", "expected_profit", "exit_expected_profit", "loss_probability", "sale_by_horizon", "no_sale_path")
            if c in quoted.columns]
    best = best_offer(quoted.select(*told), lead)
    return recommend(best, checked.select(lead, "violations", "interval_width", "target_margin",
                                          "case_name"), lead)


def decision_summary(candidates: DataFrame, lead: str) -> DataFrame:
    """One row per case from its best offer: ratios, first action, objective and no-sale path.

    The listed prices come from ``listings`` or, where that is absent, from ``decisions``.
    """
    # Told of every candidate, so that only these few values are shuffled.
    premium = lambda cents: cents / 100.0 / F.col("prelisting_reference") - 1
    first = F.element_at("no_sale_path", 1)
    if "listings" in candidates.columns:
        least, greatest, prices = (F.col("listings")[name] for name in ("least", "greatest", "prices"))
    else:
        cents = F.transform("decisions", lambda d: d["cents"])
        least, greatest, prices = F.array_min(cents), F.array_max(cents), F.size(F.array_distinct(cents))
    return best_offer(candidates.select(
        lead, "case_name", "offer",
        (F.col("offer") / F.col("reference")).alias("offer_ratio"), "acceptance",
        F.when(F.col("objective") > 0, "price").otherwise("abstain").alias("recommendation"),
        first["action"].alias("first_action"), premium(first["cents"]).alias("first_premium"),
        F.size("no_sale_path").alias("path_weeks"),
        "expected_profit", "downside_cvar_loss", "objective", "loss_probability",
        premium(least).alias("premium_min"), premium(greatest).alias("premium_max"),
        prices.alias("premium_count"),
        F.concat_ws(",", F.transform("no_sale_path", lambda d: d["action"])).alias("path"),
    ), lead)


def sequential_picks(df: DataFrame, key: str,
                     profiles: Sequence[tuple[str, Column, Column | None]]) -> DataFrame:
    """Best row per profile in turn, each excluding the rows picked before it.

    A profile picks one row, so the exclusion list is as long as the list of profiles.
    """
    picked, parts = [], []
    for name, score, condition in profiles:
        open_rows = df.filter(~F.col(key).isin(picked)) if picked else df
        if condition is not None:
            open_rows = open_rows.filter(condition)
        best = open_rows.orderBy(score.desc(), key).select(key).first()
        if best is None:
            raise ValueError(f"no row qualifies for profile {name}")
        picked.append(best[0])
        parts.append((name, best[0]))
    wanted = df.sparkSession.createDataFrame(parts, f"profile string, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(wanted), key)  # one row per profile


def consequential_interval(lower: Column, prediction: Column, reference: Column) -> Column:
    """Whether the lower stress point binds initial proceeds while the prediction does not."""
    cap = 0.995 * (1.04 * reference)
    return (lower < cap) & (cap < prediction)


def sparse_support_score(homes: DataFrame, training: DataFrame, *, submarket: str = "submarket", size: str = "square_feet") -> DataFrame:
    """Adds ``sparse_score``: high for homes of few training rows in their submarket, of unusual size and with a wide interval.

    -ln(1 + training rows) + 0.35 |z(ln size)| + 0.5 z(interval width as a share of the prediction). ``homes`` carry
    lower, prediction and upper. Equal widths that differ in their last bits have z zero.
    """
    support = training.groupBy(F.col(submarket).alias("_where")).agg(F.count(F.lit(1)).alias("_support"))
    rated = homes.join(support, F.col(submarket) == F.col("_where"), "left").withColumns({
        "_size": F.ln(size), "_width": F.round((F.col("upper") - F.col("lower")) / F.col("prediction"), 9)})
    score = -F.log1p(F.coalesce("_support", F.lit(0))) + 0.35 * F.abs("_size_z") + 0.5 * F.col("_width_z")
    return zscores(rated, ["_size", "_width"]).withColumn("sparse_score", score).drop(
        "_where", "_support", "_size", "_width", "_size_z", "_width_z")
