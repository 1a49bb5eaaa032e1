"""Queries for the fitted estimators and the two studies."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from homespell.functions import pricing as P
from homespell.operators import decisions as D
from homespell.operators import models as M
from homespell.operators import markdown, panels, survival
from homespell.plans import bindings as B
from homespell.plans.query import Registry

registry = Registry()
query = registry.add

WEEKS, SEASON = 156, 17
SPEC = M.FeatureSpec(("offer_ratio", "log_price"), ("grp",))
HAZARD = M.FeatureSpec(("list_price_premium",), ("grp",))


def _offers(spark, sf):
    """Orders as quoted offers: urgent orders and high ratios are accepted more often."""
    key = F.col("o_orderkey")
    return B.read(spark, sf, "orders").select(
        key.alias("lead_id"), F.col("o_orderpriority").alias("grp"),
        (0.82 + key % 201 / 1000).alias("offer_ratio"), F.ln("o_totalprice").alias("log_price"),
        ((F.col("o_orderstatus") == "F") | ((key * 7919) % 201 < key % 201)).cast("int").alias("accepted"),
        F.col("o_totalprice").alias("price"),
    )


def _listings(spark, sf):
    return B.units(spark, sf).filter("duration_weeks >= 1").withColumn(
        "list_price_premium", F.col("unit") % 46 / 100 - 0.30)


def _episode_panel(spark, sf):
    return panels.episode_panel(B.episode_table(spark, sf))


def _repeats(spark, sf):
    return panels.repeat_sale_window(B.panel_table(spark, sf))


@query("j1_feature_pipeline", "lead_id i, offer_z f8, price_z f8, indicators i, width i",
       """WITH o AS (SELECT o_orderkey AS lead_id, 0.82::DOUBLE + o_orderkey % 201 / 1000::DOUBLE AS r, ln(o_totalprice) AS p FROM orders)
       SELECT lead_id, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS offer_z, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS price_z,
       1 AS indicators, 2 + (SELECT count(DISTINCT o_orderpriority) FROM orders) AS width FROM o""")
def _(spark, sf):
    offers = _offers(spark, sf)
    out = M.fit_features(offers, SPEC).transform(offers)
    values = vector_to_array("features")
    return out.select(
        "lead_id", values[0].alias("offer_z"), values[1].alias("price_z"), F.size(values).alias("width"),
        F.aggregate(F.slice(values, F.lit(3), F.greatest(F.size(values) - 2, F.lit(0))), F.lit(0.0), lambda a, x: a + x).alias("indicators"))


@query("j2_acceptance_logit", "lead_id i, probability f6, predicted i")
def _(spark, sf):
    offers = _offers(spark, sf)
    return M.fit_acceptance(offers, SPEC).predict(offers)


@query("j3_hazard_logit", "unit i, period i, hazard f6, survival f6")
def _(spark, sf):
    listings = _listings(spark, sf)
    model = M.fit_hazard(listings, HAZARD, SEASON, "duration_weeks", "event_observed")
    grid = survival.horizon_grid(listings.select("unit", "grp", "list_price_premium"), SEASON)
    return survival.survival_curve(M.score_hazard(model, grid), ["unit"])


def _operator_model(spark, sf):
    return M.fit_operator_hazard(_episode_panel(spark, sf), M.EXIT_FEATURES, WEEKS)


@query("j4_operator_hazard_logit", "operator s, period i, hazard f6, n i")
def _(spark, sf):
    spells = _episode_panel(spark, sf)
    model = M.fit_operator_hazard(spells, M.EXIT_FEATURES, WEEKS)
    scored = M.score_hazard(model, survival.person_period(spells, max_periods=WEEKS))
    return scored.groupBy("operator", "period").agg(F.avg("hazard").alias("hazard"), F.count(F.lit(1)).alias("n"))


@query("j5_operator_effects", "operator s, reference b, log_hazard_difference f5, hazard_odds_ratio f5")
def _(spark, sf):
    return _operator_model(spark, sf).effects(spark, "operator")


@query("j6_coefficient_table", "feature s, coefficient f5")
def _(spark, sf):
    return M.fit_acceptance(_offers(spark, sf), SPEC).coefficient_table(spark)


@query("j7_linear_conformal", "lead_id i, prediction f2, lower f2, upper f2")
def _(spark, sf):
    homes = _offers(spark, sf)
    spec = M.FeatureSpec(("offer_ratio",), ("grp",))
    return M.fit_linear_conformal(homes, "price", spec, row_key="lead_id").transform(homes)


@query("j8_gbt_conformal", "parcel_id s, sale_date d, seq i, prediction f2, lower f2, upper f2")
def _(spark, sf):
    sales = _repeats(spark, sf)
    parted = M.splits.grouped_split(sales, "parcel_id", 0.2, 0)
    model = M.fit_gbt_conformal(
        parted.filter("NOT is_calibration"), parted.filter("is_calibration"), "sale_price",
        M.VALUATION_FEATURES, scale="lagged_market_median_price")
    return model.transform(sales)


@query("d11_score_attach", "market s, n i, ordered i, covered i")
def _(spark, sf):
    sales = _repeats(spark, sf)
    model = M.fit_linear_conformal(sales.withColumn("sale_id", F.concat("parcel_id", F.lit(":"), "seq")),
                                   "sale_price", M.VALUATION_FEATURES, row_key="sale_id")
    scored = model.transform(sales)
    inside = F.col("sale_price").between(F.col("lower"), F.col("upper"))
    return scored.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lower") <= F.col("upper")).alias("ordered"),
        F.count_if(inside).alias("covered"))


@query("j11_offer_curve", "offer_ratio f4, acceptance_probability f6")
def _(spark, sf):
    offers = _offers(spark, sf)
    ratios = [0.82 + 0.20 * i / 30 for i in range(31)]
    return M.offer_curve(M.fit_acceptance(offers, SPEC), offers, ratios)


@query("j12_response_effect", "log_odds_effect f5, increasing b, recovery_error f5")
def _(spark, sf):
    offers = _offers(spark, sf)
    curve = M.offer_curve(M.fit_acceptance(offers, SPEC), offers, [0.86, 0.96])
    return M.response_effect(curve, 0.86, 0.96, truth=0.5)


@query("j13_valuation_study", "sample s, predictor s, n_transactions i, mean_absolute_error f2, interval_coverage f6")
def _(spark, sf):
    _, scored = M.valuation_study(_repeats(spark, sf), B.MARKET_A, B.MARKET_B)
    return M.valuation_scores(scored)


@query("j14_exit_study", "sample s, n_risk_rows i, n_events_within_horizon i, n_episodes i, n_parcels i, person_period_brier_score f6, "
       "brier_skill_score f5, person_period_log_loss f6, risk_row_auc f5")
def _(spark, sf):
    _, scored = M.exit_study(_episode_panel(spark, sf), B.MARKET_A, B.MARKET_B)
    return M.exit_scores(scored)


@query("j15_sensitivity_rerun", "sample s, predictor s, rule s, n_transactions i, mean_absolute_error f2, "
       "window_start d, window_end d")
def _(spark, sf):
    return M.sensitivity_rerun(_repeats(spark, sf), B.MARKET_A, B.MARKET_B)


def season_hazard(spark, sf):
    return M.fit_hazard(_listings(spark, sf), HAZARD, SEASON, "duration_weeks", "event_observed")


def season_homes(spark, sf):
    return D.adapt_requests(B.leads(spark, sf)).withColumn("grp", F.when(
        F.col("property_id") % 2 == 0, "1-URGENT").otherwise("5-LOW"))


@query("k8_score_states", "property_id i, week i, states i, supported i, least_hazard f6, greatest_hazard f6")
def _(spark, sf):
    """Hazards of all states of the season's lattice, summed up per week."""
    model = season_hazard(spark, sf)
    homes = season_homes(spark, sf)
    # What the hazard is scored by is joined to the homes, since a home has thousands of states.
    homes = homes.select("property_id", "list_price", "prelisting_reference").join(homes.select("property_id", "grp"), "property_id")
    lattice = markdown.price_lattice(homes, D.PricingConfig(horizon_weeks=SEASON, min_list_price_ratio=0.7),
                                     "property_id", P.LIST_PREMIUM_SUPPORT, keep=("grp", "prelisting_reference"))
    states = M.score_states(model, lattice)
    return states.groupBy("property_id", "week").agg(
        F.count(F.lit(1)).alias("states"), F.count_if("in_support").alias("supported"),
        F.min("hazard").alias("least_hazard"), F.max("hazard").alias("greatest_hazard"))
