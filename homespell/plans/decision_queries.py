"""Queries for pricing decisions over a table of leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from homespell.functions import pricing as P
from homespell.operators import decisions as D
from homespell.operators import markdown, metrics
from homespell.operators import models as M
from homespell.plans import bindings as B
from homespell.plans import model_queries
from homespell.plans.query import Registry

registry = Registry()
query = registry.add

POLICY = D.PricingConfig(horizon_weeks=17)


def cents_sql(x: str) -> str:
    low = f"floor(({x}) * 100)"
    half = f"(({low} + 0.5::DOUBLE) / 100::DOUBLE)"
    high = f"({half} * 134217729::DOUBLE - ({half} * 134217729::DOUBLE - {half}))"
    off = f"(({high} * 200 - ({low} * 2 + 1)) + ({half} - {high}) * 200)"
    return (f"CAST({low} + CASE WHEN ({x}) > {half} THEN 1 WHEN ({x}) < {half} THEN 0 "
            f"WHEN {off} > 0 THEN 1 WHEN {off} < 0 THEN 0 ELSE {low} % 2 END AS BIGINT)")


_CASE_SQL = "cases AS (SELECT * FROM (VALUES " + ", ".join(
    "('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}, "
    "{}::DOUBLE, {}::DOUBLE[], {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, "
    "{}::DOUBLE, {}::DOUBLE)".format(*[list(v) if isinstance(v, tuple) else v for v in case[:-1]])
    for case in D.CASES
) + (") t(case_name, tref, shift, urgency, tweekly, rate, tfixed, tacq, prelist, tlist, grid, base, "
     "elast, dom, midpoint, slope, intercept, tav, liq))")
_SCEN_SQL = "scen AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{case[0]}', '{name}', {q}::DOUBLE, {vm}::DOUBLE, {dm}::DOUBLE)"
    for case in D.CASES for name, q, vm, dm in case[-1]
) + ") t(case_name, sname, q, vm, dm))"

_ADAPT_SQL = f"""{B.LEADS}, {_CASE_SQL}, {_SCEN_SQL},
near AS (SELECT l.property_id, c.* FROM leads l, cases c QUALIFY row_number() OVER (
 PARTITION BY l.property_id ORDER BY abs(ln(l.value / c.tref)), c.case_name) = 1),
adapted AS (SELECT l.*, n.* EXCLUDE (property_id), value * (tlist / tref) AS list_price, tfixed * (value / tref) AS fixed_cost,
 tacq * (value / tref) AS acquisition_cost FROM leads l JOIN near n USING (property_id)),
offers0 AS (SELECT a.*, {cents_sql('value * (g / tref)')} / 100::DOUBLE AS raw_offer
 FROM (SELECT *, unnest(grid) AS g FROM adapted) a),
offers AS (SELECT *, CASE WHEN raw_offer / value < 0.82::DOUBLE THEN value * 0.82::DOUBLE
 WHEN raw_offer / value > 1.02::DOUBLE THEN value * 1.02::DOUBLE ELSE raw_offer END AS offer FROM offers0)"""

# Weekly path under the calendar: hold, then a 2.5% cut every second week from week two.
_PATH_SQL = f"""RECURSIVE {_ADAPT_SQL},
path AS (SELECT property_id, 0 AS week, {cents_sql('list_price')} AS c FROM adapted
 UNION ALL SELECT property_id, week + 1, {cents_sql(
    'c / 100::DOUBLE * (1 - CASE WHEN week + 1 >= 2 AND (week + 1 - 2) % 2 = 0 THEN 0.025::DOUBLE ELSE 0 END)')}
 FROM path WHERE week + 1 < 17)"""

_POLICY_SQL = _PATH_SQL + """,
hz AS (SELECT a.property_id, week, sname, q, c / 100::DOUBLE AS price, value * vm AS sv,
 1 / (1 + exp(-(ln(base / (1 - base)) - elast * (c / 100::DOUBLE / (value * vm) - 1) + dom * week + ln(dm) + shift))) AS h
 FROM adapted a JOIN path USING (property_id) JOIN scen USING (case_name)),
hz2 AS (SELECT *, least(price * (1 - 0.005::DOUBLE), sv) AS proceeds FROM hz),
wk AS (SELECT property_id, week, sum(q * h) AS sold FROM hz2 GROUP BY 1, 2),
alive AS (SELECT *, coalesce(product(1 - sold) OVER (PARTITION BY property_id ORDER BY week
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS alive FROM wk),
atom0 AS (SELECT property_id, week, sname, alive * q * h AS p, proceeds FROM hz2 JOIN alive USING (property_id, week)
 UNION ALL SELECT z.property_id, week, sname, alive * q * (1 - h), proceeds * liq FROM hz2 z
 JOIN alive USING (property_id, week) JOIN adapted a ON a.property_id = z.property_id WHERE week = 16),
atom AS (SELECT o.property_id, o.offer, o.risk_aversion, 1 / (1 + exp(-(intercept + urgency + slope * (o.offer / o.value - midpoint)))) AS acc,
 p, t.proceeds - o.offer - repair_cost - acquisition_cost - (fixed_cost + rate * t.proceeds)
 - (prelist + week + 1) * weekly_holding_cost AS profit FROM offers o JOIN atom0 t USING (property_id)),
horizon AS (SELECT property_id, 1 - product(1 - sold) AS sale_by_horizon FROM wk GROUP BY 1)"""


def _tail_sql(source: str, out: str) -> str:
    return f"""{out}_c AS (SELECT *, sum(p) OVER (PARTITION BY property_id, offer ORDER BY profit, p
 ROWS UNBOUNDED PRECEDING) AS upto FROM {source}),
{out} AS (SELECT property_id, offer, any_value(risk_aversion) AS lam, any_value(acc) AS acc, sum(p * profit) AS mean,
 sum(greatest(0, least(upto, 0.1::DOUBLE) - (upto - p)) * greatest(-profit, 0)) / 0.1::DOUBLE AS cvar,
 coalesce(sum(p) FILTER (profit < 0), 0) AS loss FROM {out}_c GROUP BY 1, 2)"""


_QUOTE_SQL = _POLICY_SQL + """,
mixed AS (SELECT property_id, offer, risk_aversion, acc, p * acc AS p, profit FROM atom
 UNION ALL SELECT DISTINCT property_id, offer, risk_aversion, acc, 1 - acc, 0 FROM atom),
""" + _tail_sql("atom", "ext") + ",\n" + _tail_sql("mixed", "quo") + """,
ranked AS (SELECT quo.*, ext.mean AS exit_mean, quo.mean - quo.lam * quo.cvar AS objective,
 row_number() OVER (PARTITION BY quo.property_id ORDER BY quo.mean - quo.lam * quo.cvar DESC, quo.mean DESC, quo.offer)
 AS rk FROM quo JOIN ext USING (property_id, offer))"""


def _adapted(spark, sf):
    return D.adapt_requests(B.leads(spark, sf))


def _outcomes(adapted):
    return D.policy_outcomes(adapted, D.scheduled_cuts(POLICY.horizon_weeks), POLICY)


def _policy(rows):
    cuts = D.scheduled_cuts(POLICY.horizon_weeks)
    return D.evaluate_policy(rows, cuts, POLICY)


def _quotes(spark, sf):
    quoted = D.quote(_policy(D.explode_offers(_outcomes(_adapted(spark, sf)))))
    return quoted.drop("atoms", "exit_atoms", "scenarios", "path")


@query("d9_nearest_template", "property_id i, case_name s",
       f"WITH {_ADAPT_SQL} SELECT property_id, case_name FROM near")
def _(spark, sf):
    return B.leads(spark, sf).select(
        "property_id", D.nearest_template(F.col("value"))["name"].alias("case_name"))


@query("g3_best_offer", "property_id i, offer f2, objective f4, expected_profit f4",
       f"""WITH {_QUOTE_SQL} SELECT property_id, offer, objective, mean AS expected_profit FROM ranked WHERE rk = 1""")
def _(spark, sf):
    return D.best_offer(_quotes(spark, sf), "property_id")


@query("g4_target_acceptance_offer", "property_id i, offer f2",
       f"""WITH {_ADAPT_SQL} SELECT property_id, coalesce(min(offer) FILTER (
       1 / (1 + exp(-(intercept + urgency + slope * (offer / value - midpoint)))) >= 0.5), max(offer)) AS offer
       FROM offers GROUP BY 1""")
def _(spark, sf):
    def accepted(offer):
        return P.sigmoid(F.col("intercept") + F.col("urgency")
                         + F.col("slope") * (offer / F.col("value") - F.col("midpoint")))
    return _adapted(spark, sf).select(
        "property_id", D.target_acceptance_offer(F.col("offers"), accepted, 0.5).alias("offer"))


@query("g5_best_action", "o_orderkey i, action s",
       """WITH v AS (SELECT o_orderkey, [0, (o_orderkey % 3 - 1) / 10.0, (o_orderkey % 5 - 2) / 10.0, (o_orderkey % 7 - 3) / 10.0] AS o FROM orders)
       SELECT o_orderkey, ['hold', 'cut_1_pct', 'cut_2_5_pct', 'cut_5_pct'][list_position(o, list_max(o))] AS action FROM v""")
def _(spark, sf):
    key = F.col("o_orderkey")
    objectives = (F.lit(0.0), (key % 3 - 1) / 10.0, (key % 5 - 2) / 10.0, (key % 7 - 3) / 10.0)
    options = F.array(*[
        F.struct(F.lit(name).alias("action"), value.cast("double").alias("objective"))
        for (name, _), value in zip(P.ACTIONS, objectives, strict=True)
    ])
    best = D.first_best(options, lambda c: c["objective"], "struct<action:string,objective:double>")
    return B.read(spark, sf, "orders").select("o_orderkey", best["action"].alias("action"))


@query("i5_price_path", "property_id i, week i, cents i", f"WITH {_PATH_SQL} SELECT property_id, week, c AS cents FROM path")
def _(spark, sf):
    rows = D.price_path(_adapted(spark, sf), D.scheduled_cuts(POLICY.horizon_weeks))
    return rows.select("property_id", F.posexplode("path").alias("week", "cents"))


_LATTICE_SQL = f"""RECURSIVE {_ADAPT_SQL}, cut(k) AS (VALUES (0::DOUBLE), (0.01::DOUBLE), (0.025::DOUBLE), (0.05::DOUBLE)),
lat AS (SELECT property_id, -1 AS week, {cents_sql('list_price')} AS c, value FROM adapted
 UNION SELECT property_id, week + 1, {cents_sql('c / 100::DOUBLE * (1 - k)')}, value FROM lat, cut
 WHERE week + 1 < 17 AND (k = 0 OR {cents_sql('c / 100::DOUBLE * (1 - k)')} / 100::DOUBLE >= value * 0.7::DOUBLE))"""


@query("i6_price_lattice", "property_id i, week i, prices i, least i, greatest i, cents_sum i",
       f"""WITH {_LATTICE_SQL} SELECT property_id, week, count(*) AS prices, min(c) AS least, max(c) AS greatest,
       CAST(sum(c) AS BIGINT) AS cents_sum FROM lat WHERE week >= 0 GROUP BY 1, 2""")
def _(spark, sf):
    return markdown.price_lattice(_adapted(spark, sf), POLICY, "property_id").groupBy("property_id", "week").agg(
        F.count(F.lit(1)).alias("prices"), F.min("cents").alias("least"), F.max("cents").alias("greatest"), F.sum("cents").alias("cents_sum"))


@query("i7_markdown_floor", "property_id i, action s, cents i",
       f"""WITH {B.LEADS}, a(action, k) AS (VALUES ('hold', 0::DOUBLE), ('cut_1_pct', 0.01::DOUBLE),
       ('cut_2_5_pct', 0.025::DOUBLE), ('cut_5_pct', 0.05::DOUBLE)),
       s AS (SELECT property_id, value, {cents_sql('value * (0.68::DOUBLE + property_id % 8 / 100::DOUBLE)')} AS c FROM leads)
       SELECT property_id, action, {cents_sql('c / 100::DOUBLE * (1 - k)')} AS cents FROM s, a
       WHERE action = 'hold' OR {cents_sql('c / 100::DOUBLE * (1 - k)')} / 100::DOUBLE >= value * 0.7::DOUBLE""")
def _(spark, sf):
    price = P.cents(F.col("value") * (F.lit(0.68) + F.col("property_id") % 8 / 100))
    options = D.feasible_cents(F.col("c"), F.col("value") * 0.7)
    return B.leads(spark, sf).withColumn("c", price).select("property_id", F.inline(options))


@query("k1_evaluate_policy", "property_id i, offer f2, expected_profit f4, downside_cvar_loss f4, objective f4, "
       "sale_by_horizon f9",
       f"""WITH {_POLICY_SQL}, {_tail_sql('atom', 'ext')} SELECT property_id, offer, mean AS expected_profit,
       cvar AS downside_cvar_loss, mean - lam * cvar AS objective, sale_by_horizon FROM ext JOIN horizon USING (property_id)""")
def _(spark, sf):
    return _policy(D.explode_offers(_outcomes(_adapted(spark, sf))))


@query("k2_markdown_dp", "property_id i, offer f2, decisions i, holds i, expected_profit f4, downside_cvar_loss f4, "
       "objective f4, objective_sum f0")
def _(spark, sf):
    """Season-long program of every lead and offer: the root's values, and its decisions summed up."""
    return _solved(spark, sf, "totals").select("property_id", "offer", "totals.*", "expected_profit", "downside_cvar_loss", "objective")


def _solved(spark, sf, *parts):
    """Optimal prices over the whole season at every offer of every lead."""
    return markdown.markdown_dp(D.explode_offers(_adapted(spark, sf)), POLICY, parts=parts)


@query("k3_offer_grid", "property_id i, offer f2, acceptance f9, expected_profit f4, downside_cvar_loss f4, "
       "objective f4, loss_probability f9",
       f"""WITH {_QUOTE_SQL} SELECT property_id, offer, acc AS acceptance, mean AS expected_profit,
       cvar AS downside_cvar_loss, objective, loss AS loss_probability FROM ranked""")
def _(spark, sf):
    return _quotes(spark, sf)


@query("k4_no_sale_path", "property_id i, offer f2, week i, action s, cents i, sale_probability f9")
def _(spark, sf):
    return _solved(spark, sf, "no_sale_path").select("property_id", "offer", F.inline("no_sale_path"))


def _requests(spark, sf):
    key = F.col("property_id")
    return B.leads(spark, sf).withColumns({
        "repair_cost": F.col("repair_cost") * (1 + key % 9),
        "risk_aversion": F.col("risk_aversion") * (1 + key % 3),
        "target_margin": (key % 5) * 0.02,
    })


_GATE_SQL = _QUOTE_SQL.replace(
    "value * CAST(0.03 AS DOUBLE) AS repair_cost",
    "value * CAST(0.03 AS DOUBLE) * (1 + property_id % 9) AS repair_cost").replace(
    "k * CAST(0.3 AS DOUBLE) AS risk_aversion",
    "k * CAST(0.3 AS DOUBLE) * (1 + property_id % 3) AS risk_aversion")


@query("k5_recommendation_gate", "property_id i, recommendation s, reason s, acquisition_offer f2, expected_profit f2, "
       "probability_of_loss f6, sale_by_120_days f6",
       f"""WITH {_GATE_SQL}, w AS (SELECT case_name, max(vm) - min(vm) AS width FROM scen GROUP BY 1),
       v AS (SELECT a.property_id, array_to_string(list_filter([
         CASE WHEN repair_cost / value > 0.2::DOUBLE THEN 'repair cost above 20% of value' END,
         CASE WHEN risk_aversion > 2 THEN 'risk aversion outside support' END], lambda x: x IS NOT NULL), '; ') AS viol,
         width, a.property_id % 5 * 0.02::DOUBLE AS target FROM adapted a JOIN w USING (case_name)),
       g AS (SELECT v.*, r.*, sale_by_horizon, CASE WHEN viol <> '' THEN 'review' WHEN width > 0.2 OR objective <= 0 THEN 'abstain'
         WHEN exit_mean / offer < target THEN 'review' ELSE 'price' END AS recommendation
         FROM v JOIN ranked r ON r.property_id = v.property_id AND rk = 1 JOIN horizon h ON h.property_id = v.property_id)
       SELECT property_id, recommendation, CASE WHEN viol <> '' THEN viol WHEN width > 0.2 THEN 'scenario interval too wide'
        WHEN objective <= 0 THEN 'non-positive value' WHEN exit_mean / offer < target THEN 'margin below target'
        ELSE 'priced' END AS reason, CASE WHEN recommendation = 'price' THEN offer END AS acquisition_offer,
        CASE WHEN recommendation = 'price' THEN mean ELSE 0 END AS expected_profit,
        CASE WHEN recommendation = 'price' THEN loss ELSE 0 END AS probability_of_loss,
        CASE WHEN recommendation = 'price' THEN sale_by_horizon ELSE 0 END AS sale_by_120_days FROM g""")
def _(spark, sf):
    return D.request_gate(_requests(spark, sf), _policy, ahead=_outcomes)


@query("k6_adapt_request", "property_id i, case_name s, list_price f4, fixed_cost f4, acquisition_cost f4, offer f4",
       f"WITH {_ADAPT_SQL} SELECT * FROM offers")
def _(spark, sf):
    return D.explode_offers(_adapted(spark, sf))


@query("k7_case_parameters", "case_name s, template_reference f2, cost_rate f4, liquidation_discount f4, n_leads i",
       f"""WITH {_ADAPT_SQL} SELECT c.case_name, c.tref AS template_reference, c.rate AS cost_rate,
       c.liq AS liquidation_discount, count(n.property_id) AS n_leads FROM cases c JOIN near n USING (case_name) GROUP BY ALL""")
def _(spark, sf):
    return _adapted(spark, sf).groupBy(
        "case_name", "template_reference", "cost_rate", "liquidation_discount"
    ).agg(F.count(F.lit(1)).alias("n_leads"))


@query("k9_decision_summary", "property_id i, case_name s, offer f2, offer_ratio f6, acceptance f6, recommendation s, "
       "first_action s, path_weeks i, expected_profit f2, downside_cvar_loss f2, objective f2, loss_probability f6, "
       "premium_min f6, premium_max f6, premium_count i, path s")
def _(spark, sf):
    """Over the hazard that k8 fits and scores."""
    homes = model_queries.season_homes(spark, sf)
    model = model_queries.season_hazard(spark, sf)
    offers = D.explode_offers(M.hazard_terms(model, homes, POLICY.horizon_weeks, "grp"))
    solved = D.quote(markdown.markdown_dp(offers, POLICY, lines=markdown.fitted_lines, parts=("listings", "no_sale_path", "atoms")))
    return D.decision_summary(solved.drop("atoms", "exit_atoms", "scenarios"), "property_id")


def _optimized(rows):
    """The program in place of the calendar of ``_policy``; the chance of a sale is that of its no-sale path."""
    solved = markdown.markdown_dp(rows, POLICY, parts=("no_sale_path", "atoms"))
    return solved.withColumn("sale_by_horizon", D.sale_on_path(F.col("no_sale_path")))


@query("k10_optimized_offers", "property_id i, offer f2, acceptance f9, expected_profit f4, downside_cvar_loss f4, objective f4, "
       "loss_probability f9, sale_by_horizon f9, best b")
def _(spark, sf):
    """Offer grid (k3) and best offer (g3) over the program."""
    quoted = D.quote(_optimized(D.explode_offers(_adapted(spark, sf)))).drop("atoms", "exit_atoms", "scenarios", "no_sale_path")
    columns = ("offer", "acceptance", "expected_profit", "downside_cvar_loss", "objective", "loss_probability", "sale_by_horizon")
    rank = F.struct("objective", "expected_profit", (-F.col("offer")).alias("_cheap"))
    grids = quoted.groupBy("property_id").agg(F.collect_list(F.struct(*columns)).alias("o"), F.max_by("offer", rank).alias("_best"))
    return grids.select("property_id", "_best", F.inline("o")).withColumn("best", F.col("offer") == F.col("_best"))


@query("k11_optimized_gate", "property_id i, recommendation s, reason s, acquisition_offer f2, expected_profit f2, "
       "probability_of_loss f6, sale_by_120_days f6, policy s")
def _(spark, sf):
    """The gate (k5) over the program, with the weekly policy of priced requests."""
    return D.request_gate(_requests(spark, sf), _optimized).withColumn("policy", F.to_json("policy"))


#: Leads with their nation as the submarket, a floor area and a reference below or above their value; orders are the sales of the
#: training market, at a price around the lead's value.
_FITTED_HOMES = f"""{B.LEADS}, homes AS (SELECT property_id, value, balance, c_nationkey AS submarket,
 CAST(900 + property_id * 37 % 2401 AS DOUBLE) AS square_feet, value * (CAST(0.9 AS DOUBLE) + property_id % 29 / 100::DOUBLE) AS reference
 FROM leads JOIN customer ON c_custkey = property_id),
sales AS (SELECT o_orderkey AS sale_id, submarket, ln(value) AS x, ln(value * (CAST(0.85 AS DOUBLE) + o_orderkey % 41 / 100::DOUBLE)) AS y,
 CAST('0x' || substr(md5('0:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296::DOUBLE < 0.2::DOUBLE AS held FROM orders JOIN homes ON o_custkey = property_id),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM sales WHERE NOT held),
ranked AS (SELECT abs(y - a - b * x) AS r, row_number() OVER (ORDER BY abs(y - a - b * x)) AS rk, count(*) OVER () AS n FROM sales, line WHERE held),
radius AS (SELECT min(r) FILTER (rk = least(n, ceil((n + 1) * 0.9::DOUBLE) + 1)) AS w FROM ranked),
fitted AS (SELECT homes.*, exp(a + b * ln(value)) AS prediction, exp(a + b * ln(value) - w) AS lower, exp(a + b * ln(value) + w) AS upper FROM homes, line, radius),
support AS (SELECT submarket, count(*) AS n FROM sales WHERE NOT held GROUP BY 1)"""


def _fitted_homes(spark, sf):
    """Leads with their fitted intervals, and the training sales."""
    leads, customer = B.leads(spark, sf), B.read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("submarket"))
    key = F.col("property_id")
    homes = leads.join(customer, F.col("c_custkey") == key).drop("c_custkey").withColumns({
        "square_feet": (900 + key * 37 % 2401).cast("double"), "reference": F.col("value") * (0.9 + key % 29 / 100), "log_value": F.ln("value")})
    orders = B.read(spark, sf, "orders").select(F.col("o_orderkey").alias("sale_id"), "o_custkey")
    sales = orders.join(homes, F.col("o_custkey") == key).select(
        "sale_id", "submarket", "log_value", (F.col("value") * (0.85 + F.col("sale_id") % 41 / 100)).alias("price"))
    model = M.fit_linear_conformal(sales, "price", M.FeatureSpec(("log_value",)), row_key="sale_id")
    training = M.splits.grouped_split(sales, F.col("sale_id").cast("string"), 0.2, 0).filter("NOT is_calibration")
    return model.transform(homes), training


@query("g2_profile_argmax", "profile s, property_id i",
       f"""WITH {_FITTED_HOMES}, z AS (SELECT property_id, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS bz,
       (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS vz,
       abs((ln(square_feet) - avg(ln(square_feet)) OVER ()) / stddev_pop(ln(square_feet)) OVER ()) AS distance,
       round((upper - lower) / prediction, 9) AS width, coalesce(n, 0) AS support,
       lower < 0.995::DOUBLE * (1.04::DOUBLE * reference) AND 0.995::DOUBLE * (1.04::DOUBLE * reference) < prediction AS binding
       FROM fitted LEFT JOIN support USING (submarket)),
       scored AS (SELECT *, -ln(1 + support) + 0.35::DOUBLE * distance + 0.5::DOUBLE * CASE WHEN stddev_pop(width) OVER () = 0 THEN 0
        ELSE (width - avg(width) OVER ()) / stddev_pop(width) OVER () END AS sparse FROM z),
       a AS (SELECT property_id FROM scored ORDER BY bz - 0.25 * vz DESC, property_id LIMIT 1),
       b AS (SELECT property_id FROM scored WHERE property_id NOT IN (FROM a) ORDER BY -bz + 0.35 * vz DESC, property_id LIMIT 1),
       c AS (SELECT property_id FROM scored WHERE property_id NOT IN (FROM a) AND property_id NOT IN (FROM b) AND binding
        ORDER BY sparse DESC, property_id LIMIT 1)
       SELECT 'healthy' AS profile, property_id FROM a UNION ALL SELECT 'stale', property_id FROM b
       UNION ALL SELECT 'sparse', property_id FROM c""")
def _(spark, sf):
    """The third pick is the lead whose fitted uncertainty matters most: its lower end binds the first proceeds, its prediction does not."""
    homes, training = _fitted_homes(spark, sf)
    rows = metrics.zscores(D.sparse_support_score(homes, training), ["balance", "value"])
    bz, vz = F.col("balance_z"), F.col("value_z")
    return D.sequential_picks(rows, "property_id", [
        ("healthy", bz - 0.25 * vz, None), ("stale", -bz + 0.35 * vz, None),
        ("sparse", F.col("sparse_score"), D.consequential_interval(F.col("lower"), F.col("prediction"), F.col("reference"))),
    ])
