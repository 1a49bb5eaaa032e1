"""Queries for filters, contracts, joins, aggregates, windows and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from homespell.functions import contracts as C
from homespell.functions import pricing as P
from homespell.operators import (
    conformal, linkage, metrics, panels, risk, scale, splits, survival,
)
from homespell.plans import bindings as B
from homespell.plans.query import Registry

registry = Registry()
query = registry.add

DECISION = "2024-01-15"
_REPEAT_COLUMNS = "parcel_id s, market s, sale_date d, sale_price f2, prior_sale_price f2"
_SPELL_COLUMNS = (
    "parcel_id s, market s, operator s, acquisition_date d, acquisition_price f2, resale_date d, "
    "resale_price f2, hold_days i, event_observed b, linkage_status s, gross_spread f2"
)


def _repeats(spark, sf):
    return panels.repeat_sale_window(B.panel_table(spark, sf))


def _episode_panel(spark, sf):
    return panels.episode_panel(B.episode_table(spark, sf))


# ---------------------------------------------------------------------------- filters, contracts

@query("c1_valuation_screen", "market s, n i, total_price f0",
       f"""WITH {B.TX} SELECT market, count(*) AS n, sum(sale_price) AS total_price FROM tx
       WHERE sale_price BETWEEN 25000 AND 10000000 AND coalesce(qualified, FALSE) AND improved
       AND (living_area_sqft IS NULL OR living_area_sqft BETWEEN 300 AND 15000) GROUP BY 1""")
def _(spark, sf):
    kept = panels.valuation_screen(B.transactions(spark, sf))
    return kept.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("sale_price").alias("total_price"))


@query("c2_analysis_universe", "parcel_id s, market s, sale_date d, sale_price f2, seq i",
       f"WITH {B.UNIVERSE} SELECT * FROM universe")
def _(spark, sf):
    return panels.analysis_universe(B.transactions(spark, sf), B.CUTOFF, B.MARKET_B)


@query("c3_operator_deeds", "parcel_id s, sale_date d, sale_price f2, buyer_operator s, seller_operator s",
       f"""WITH {B.TX} SELECT * FROM tx WHERE sale_price >= 10000
       AND (buyer_operator IS NOT NULL OR seller_operator IS NOT NULL)""")
def _(spark, sf):
    return linkage.operator_deeds(B.transactions(spark, sf))


@query("c4_episode_validity", "parcel_id s, operator s, acquisition_date d, duration_weeks i, event_observed b",
       f"WITH {B.EPISODE_PANEL} SELECT * FROM epanel")
def _(spark, sf):
    return _episode_panel(spark, sf)


@query("c5_repeat_sale_window", _REPEAT_COLUMNS + ", seasoned b",
       f"WITH {B.REPEAT} SELECT *, years_since_prior_sale >= 30 / 365.25 AS seasoned FROM repeats")
def _(spark, sf):
    return _repeats(spark, sf).withColumn(
        "seasoned", F.col("years_since_prior_sale") >= panels.SEASONED_YEARS)


@query("c6_asof_violations", "entity_id i, seq i, name s",
       f"WITH {B.FEATURES} SELECT * FROM feats WHERE available_at > TIMESTAMP '{DECISION} 00:00:00'")
def _(spark, sf):
    return C.asof_violations(B.as_of_features(spark, sf), DECISION)


@query("c7_values_as_of", "entity_id i, name s, value f6",
       f"""WITH {B.FEATURES} SELECT entity_id, name, arg_max(value, seq) AS value FROM feats
       WHERE available_at <= TIMESTAMP '{DECISION} 00:00:00' GROUP BY 1, 2""")
def _(spark, sf):
    values = C.values_as_of(B.as_of_features(spark, sf), DECISION, strict=False)
    return C.feature_map(values).select("entity_id", F.explode("features").alias("name", "value"))


@query("c8_home_contract", "errors s, n i",
       f"""WITH {B.TX}, e AS (SELECT array_to_string(list_filter([
        CASE WHEN living_area_sqft IS NULL THEN 'missing living_area_sqft' END,
        CASE WHEN year_built IS NULL THEN 'missing year_built' END,
        CASE WHEN NOT coalesce(living_area_sqft > 0, FALSE) THEN 'living_area_sqft must be positive' END,
        CASE WHEN NOT coalesce(year_built BETWEEN 1800 AND year(current_date), FALSE)
         THEN 'year_built outside supported range' END], lambda x: x IS NOT NULL), '; ') AS errors FROM tx)
       SELECT errors, count(*) AS n FROM e GROUP BY 1""")
def _(spark, sf):
    homes = B.transactions(spark, sf)
    return homes.groupBy(F.concat_ws("; ", C.home_contract(homes)).alias("errors")).agg(
        F.count(F.lit(1)).alias("n"))


@query("c9_treatment_support", "o_orderkey i, premium f9, price_supported b, offer_supported b",
       """WITH r AS (SELECT o_orderkey, (0.6::DOUBLE + o_orderkey % 71 / 100.0) AS ratio FROM orders)
       SELECT o_orderkey, least(greatest(ratio - 1, -0.30::DOUBLE), 0.15::DOUBLE) AS premium,
       ratio - 1 BETWEEN -0.30::DOUBLE - 1e-9 AND 0.15::DOUBLE + 1e-9 AS price_supported,
       ratio BETWEEN 0.82::DOUBLE AND 1.02::DOUBLE AS offer_supported FROM r""")
def _(spark, sf):
    ratio = F.lit(0.6) + F.col("o_orderkey") % 71 / 100.0
    premium, inside = P.list_premium(ratio, F.lit(1.0))
    return B.read(spark, sf, "orders").select(
        "o_orderkey", premium.alias("premium"), inside.alias("price_supported"),
        P.offer_ratio_supported(ratio).alias("offer_supported"))


@query("c10_request_violations", "property_id i, reasons s",
       f"""WITH {B.LEADS}, r AS (SELECT property_id, value, repair_cost * (1 + property_id % 9) AS repair,
        weekly_holding_cost * (1 + property_id % 8) AS weekly, risk_aversion * (1 + property_id % 3) AS a FROM leads)
       SELECT property_id, array_to_string(list_filter([
        CASE WHEN value NOT BETWEEN 100000 AND 1250000 THEN 'value outside support' END,
        CASE WHEN repair / value > 0.2::DOUBLE THEN 'repair cost above 20% of value' END,
        CASE WHEN weekly / value > 0.01::DOUBLE THEN 'weekly holding cost above 1% of value' END,
        CASE WHEN a > 2 THEN 'risk aversion outside support' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r""")
def _(spark, sf):
    key = F.col("property_id")
    reasons = C.request_violations(
        F.col("value"), F.col("repair_cost") * (1 + key % 9),
        F.col("weekly_holding_cost") * (1 + key % 8), F.col("risk_aversion") * (1 + key % 3))
    return B.leads(spark, sf).select("property_id", F.concat_ws("; ", reasons).alias("reasons"))


@query("c11_backtest_contract", "lead_id s, errors s, capital f2",
       f"""WITH {B.BACKTEST} SELECT lead_id, CASE WHEN weeks_held % 5 = 0 AND NOT accepted
       THEN 'a rejected lead cannot be sold' ELSE '' END AS errors,
       CASE WHEN accepted THEN acquisition_offer ELSE 0 END AS capital FROM bt""")
def _(spark, sf):
    broken = B.backtest(spark, sf).withColumn(
        "sold", F.col("sold") | ((F.col("weeks_held") % 5 == 0) & ~F.col("accepted")))
    return broken.select("lead_id", F.concat_ws("; ", C.backtest_contract()).alias("errors"),
                         C.effective_capital().alias("capital"))


_GUARDED = ("sale_price", "prior_sale_price", "lagged_market_median_price", "rolled_forward_prior_baseline",
            "years_since_prior_sale", "truth_value")


@query("c12_leakage_guard", "feature s, leaks b, rows_with_value i",
       f"WITH {B.PANEL}, guarded AS (SELECT *, sale_price AS truth_value FROM panel) " + " UNION ALL ".join(
           f"SELECT '{name}' AS feature, {str(name in ('sale_price', 'truth_value')).upper()} AS leaks, "
           f"count({name}) AS rows_with_value FROM guarded" for name in _GUARDED))
def _(spark, sf):
    """Columns of the repeat-sale panel that must not become features, with the rows that hold them."""
    guarded = B.panel(spark, sf).withColumn("truth_value", F.col("sale_price")).select(*_GUARDED)
    leaking = C.leaking_features(guarded.columns)
    counts = guarded.agg(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.lit(name in leaking).alias("leaks"), F.count(name).alias("rows_with_value"))
        for name in guarded.columns]).alias("columns"))
    return counts.select(F.inline("columns"))


@query("c13_operator_slice", "market s, operator s, n_acquisitions i",
       f"""WITH {B.EPISODE_PANEL} SELECT market, operator, count(*) AS n_acquisitions FROM epanel
       WHERE operator = 'opendoor' GROUP BY 1, 2""")
def _(spark, sf):
    return survival.episode_summary(_episode_panel(spark, sf)).filter(F.col("operator") == "opendoor")


# ----------------------------------------------------------------------------------------- joins

@query("d1_quarter_median_join", "parcel_id s, sale_date d, seq i, lagged_market_median_price f2, "
       "prior_market_median_price f2",
       f"WITH {B.PANEL} SELECT * FROM panel")
def _(spark, sf):
    return B.panel(spark, sf)


@query("d2_market_cutoff_join", "market s, cutoff d, n i",
       f"""WITH {B.TX}, c(market, cutoff) AS (VALUES ('market_a', DATE '1999-06-30'), ('market_b', DATE '2000-06-30'))
       SELECT market, cutoff, count(*) AS n FROM tx JOIN c USING (market) WHERE sale_date <= cutoff GROUP BY 1, 2""")
def _(spark, sf):
    cutoffs = {B.MARKET_A: "1999-06-30", B.MARKET_B: "2000-06-30"}
    kept = linkage.market_cutoff_join(B.transactions(spark, sf), cutoffs)
    return kept.groupBy("market", "cutoff").agg(F.count(F.lit(1)).alias("n"))


@query("d3_link_episodes", _SPELL_COLUMNS, f"WITH {B.EPISODES} SELECT * FROM episodes")
def _(spark, sf):
    return B.episodes(spark, sf)


@query("d4_geographic_holdout", "sample s, n i, overlap i",
       f"""WITH {B.TX} SELECT CASE market WHEN 'market_a' THEN 'development' ELSE 'holdout' END AS sample,
       count(*) AS n, 0 AS overlap FROM tx GROUP BY 1""")
def _(spark, sf):
    split = splits.geographic_holdout(B.transactions(spark, sf), B.MARKET_A, B.MARKET_B)
    overlap = splits.key_overlap(split.filter("sample = 'development'"), split.filter("sample = 'holdout'"))
    return metrics.group_counts(split, ["sample"]).withColumn("overlap", overlap.agg(F.count(F.lit(1))).scalar())


_SPLIT_SQL = """, dates AS (SELECT sale_date, row_number() OVER (ORDER BY sale_date) - 1 AS pos,
 count(*) OVER () AS n FROM (SELECT DISTINCT sale_date FROM repeats WHERE market = 'market_a')),
cuts2 AS (SELECT max(sale_date) FILTER (pos = floor(n * (1 - 0.2::DOUBLE - 0.2::DOUBLE))) AS calibration_start,
 max(sale_date) FILTER (pos = floor(n * (1 - 0.2::DOUBLE))) AS test_start FROM dates),
win AS (SELECT r.*, c.test_start, CASE WHEN sale_date >= test_start THEN 2 WHEN sale_date >= calibration_start THEN 1
 ELSE 0 END AS idx FROM repeats r, cuts2 c WHERE market = 'market_a'),
labelled AS (SELECT *, ['training', 'calibration', 'out_of_time_test'][idx + 1] AS split,
 idx = max(idx) OVER (PARTITION BY parcel_id) AS kept FROM win)"""


def _split(spark, sf):
    development = _repeats(spark, sf).filter(F.col("market") == B.MARKET_A)
    cutoffs = splits.date_cutoffs(development, "sale_date")
    return splits.chronological_split(development, "sale_date", cutoffs)


@query("d5_later_window_purge", "parcel_id s, sale_date d, seq i, split s, kept b",
       f"WITH {B.REPEAT}{_SPLIT_SQL} SELECT * FROM labelled")
def _(spark, sf):
    return _split(spark, sf)


@query("d6_disjoint_assert", "reused i, parcels i",
       f"""WITH {B.REPEAT}{_SPLIT_SQL} SELECT 0 AS reused, count(DISTINCT parcel_id) AS parcels
       FROM labelled WHERE kept""")
def _(spark, sf):
    labelled = _split(spark, sf)
    reused = splits.reused_parcels(labelled).agg(F.count(F.lit(1)))
    return labelled.filter("kept").agg(F.count_distinct("parcel_id").alias("parcels")).withColumn(
        "reused", reused.scalar())


_SUPPORT_SQL = """, support AS (SELECT operator, least(count(*) FILTER (market = 'market_a'),
 count(*) FILTER (market = 'market_b')) AS minimum_support FROM epanel WHERE improved AND
 (dor_code LIKE '01%' OR lower(property_type_code) LIKE '%single family%') GROUP BY 1)"""


def _comparable(spark, sf):
    return _comparable_of(_episode_panel(spark, sf))


def _comparable_of(spells):
    return spells.filter(F.coalesce("improved", F.lit(False)) & panels.single_family(spells))


@query("d7_supported_operator_semi", "operator s, n i",
       f"""WITH {B.EPISODE_PANEL}{_SUPPORT_SQL} SELECT operator, count(*) AS n FROM epanel
       WHERE operator IN (SELECT operator FROM support WHERE minimum_support >= 1000) GROUP BY 1""")
def _(spark, sf):
    spells = panels.episode_panel(B.episode_table(spark, sf))
    supported = splits.supported_operators(_comparable_of(spells), (B.MARKET_A, B.MARKET_B), 1000)
    return metrics.group_counts(splits.keep_supported(spells, supported), ["operator"])


@query("d8_support_lookup", "o_orderkey i, training_support i, baseline f9",
       f"""WITH {B.PROBS}, rates AS (SELECT period, avg(y) AS rate FROM probs WHERE period < 6 GROUP BY 1),
       pooled AS (SELECT avg(y) AS rate FROM probs WHERE period < 6),
       sup AS (SELECT o_orderpriority, count(*) AS training_support FROM orders WHERE o_orderpriority < '4' GROUP BY 1)
       SELECT o_orderkey, coalesce(training_support, 0) AS training_support,
       coalesce(r.rate, (SELECT rate FROM pooled)) AS baseline FROM orders o
       LEFT JOIN sup USING (o_orderpriority) LEFT JOIN rates r ON r.period = o_orderkey % 7 + 1""")
def _(spark, sf):
    orders = B.read(spark, sf, "orders").withColumn("period", (F.col("o_orderkey") % 7 + 1).cast("int"))
    training = orders.filter(F.col("o_orderpriority") < "4")
    rates = metrics.period_rate(B.probabilities(spark, sf).filter(F.col("period") < 6), "period", "y")
    supported = metrics.support_lookup(orders, training, "o_orderpriority")
    return metrics.rate_lookup(supported, rates)


@query("d10_counterfactual_cross", "property_id i, ratio f2, offer f2",
       f"""WITH {B.LEADS} SELECT property_id, r AS ratio, value * CAST(r * 100 AS INTEGER) / 100 AS offer
       FROM leads, (SELECT unnest([0.82, 0.92, 1.02]) AS r)""")
def _(spark, sf):
    grid = F.explode(F.array(*[F.lit(r) for r in (0.82, 0.92, 1.02)]))
    return B.leads(spark, sf).select("property_id", "value", grid.alias("ratio")).withColumn(
        "offer", P.round_cents(F.col("value") * F.col("ratio")))


_CARD_COLUMNS = (
    "policy_name s, n_leads i, n_accepted i, n_sold i, acceptance_rate f9, sell_through_rate f9, "
    "sell_through_90d f9, sell_through_120d f9, mean_profit_per_lead f4, "
    "mean_profit_per_accepted_home f4, contribution_margin f9, contribution_margin_bps f5, "
    "median_weeks_held f2, loss_rate f9, downside_cvar_loss f4, p10_profit f4, "
    "total_capital_days f0, mean_capital_days_per_accepted_home f1, "
    "mean_markdowns_per_accepted_home f9"
)
_CARD_SQL = f"""{B.BACKTEST}, tails AS (SELECT policy_name,
  row_number() OVER w / CAST(count(*) OVER (PARTITION BY policy_name) AS DOUBLE) AS upto,
  1 / CAST(count(*) OVER (PARTITION BY policy_name) AS DOUBLE) AS p, profit
  FROM bt WINDOW w AS (PARTITION BY policy_name ORDER BY profit, lead_id)),
 tail AS (SELECT policy_name, sum(greatest(0, least(upto, 0.1::DOUBLE) - (upto - p)) * greatest(-profit, 0)) / 0.1::DOUBLE
  AS downside_cvar_loss, min(profit) FILTER (upto + 1e-9 >= 0.1::DOUBLE) AS p10_profit FROM tails GROUP BY 1),
 agg AS (SELECT policy_name, count(*) AS n_leads, count(*) FILTER (accepted) AS n_accepted,
  count(*) FILTER (sold) AS n_sold, count(*) FILTER (sold AND weeks_held <= 13) AS s90,
  count(*) FILTER (sold AND weeks_held <= 18) AS s120, avg(profit) AS mean_profit_per_lead,
  sum(profit) FILTER (accepted) AS ap, sum(sale_price) FILTER (sold) AS rev,
  median(weeks_held) FILTER (accepted) AS median_weeks_held,
  count(*) FILTER (accepted AND profit < 0) AS losses,
  sum(acquisition_offer * weeks_held * 7) FILTER (accepted) AS total_capital_days,
  sum(markdown_count) FILTER (accepted) AS mk FROM bt GROUP BY 1),
 card AS (SELECT policy_name, n_leads, n_accepted, n_sold, n_accepted / n_leads AS acceptance_rate,
  n_sold / n_accepted AS sell_through_rate, s90 / n_accepted AS sell_through_90d,
  s120 / n_accepted AS sell_through_120d, mean_profit_per_lead,
  ap / n_accepted AS mean_profit_per_accepted_home, ap / rev AS contribution_margin,
  ap / rev * 10000 AS contribution_margin_bps, median_weeks_held, losses / n_accepted AS loss_rate,
  downside_cvar_loss, p10_profit, total_capital_days,
  total_capital_days / n_accepted AS mean_capital_days_per_accepted_home,
  mk / n_accepted AS mean_markdowns_per_accepted_home FROM agg JOIN tail USING (policy_name))"""


@query("d12_compare_to_baseline", "policy_name s, baseline_name s, profit_per_lead_lift f4, "
       "contribution_margin_bps_lift f5, acceptance_rate_lift f9, sell_through_rate_lift f9, "
       "median_weeks_held_change f2, loss_rate_change f9, downside_cvar_loss_change f4",
       f"""WITH {_CARD_SQL} SELECT c.policy_name, b.policy_name AS baseline_name,
       c.mean_profit_per_lead - b.mean_profit_per_lead AS profit_per_lead_lift,
       c.contribution_margin_bps - b.contribution_margin_bps AS contribution_margin_bps_lift,
       c.acceptance_rate - b.acceptance_rate AS acceptance_rate_lift,
       c.sell_through_rate - b.sell_through_rate AS sell_through_rate_lift,
       c.median_weeks_held - b.median_weeks_held AS median_weeks_held_change,
       c.loss_rate - b.loss_rate AS loss_rate_change,
       c.downside_cvar_loss - b.downside_cvar_loss AS downside_cvar_loss_change
       FROM card c JOIN card b ON b.policy_name = '5-LOW' AND c.policy_name <> '5-LOW'""")
def _(spark, sf):
    return metrics.compare_to_baseline(metrics.policy_scorecard(B.backtest(spark, sf)), "5-LOW")


# ------------------------------------------------------------------------------------ aggregates

@query("e1_market_counts", "market s, n i",
       f"""WITH {B.RAW} SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE market END AS market,
       count(*) AS n FROM raw GROUP BY 1""")
def _(spark, sf):
    raw = B.raw_deeds(B.read(spark, sf, "lineitem"))
    partly = raw.withColumn("market", F.when(F.col("l_returnflag") != "N", F.col("market")))
    return metrics.group_counts(partly, ["market"])


@query("e2_status_counts", "market s, linkage_status s, n i",
       f"WITH {B.EPISODES} SELECT market, linkage_status, count(*) AS n FROM episodes GROUP BY 1, 2")
def _(spark, sf):
    return metrics.group_counts(B.episodes(spark, sf), ["market", "linkage_status"])


@query("e3_selection_audit", "market s, date_price_improved_single_family i, officially_qualified i, "
       "warranty_deed_proxy i, selected i",
       f"""WITH {B.TX}, {B.FLAGS} SELECT market, count(*) FILTER (is_base) AS date_price_improved_single_family,
       count(*) FILTER (is_base AND is_official) AS officially_qualified,
       count(*) FILTER (is_base AND is_proxy) AS warranty_deed_proxy,
       count(*) FILTER (is_base AND (is_official OR is_proxy)) AS selected FROM flags GROUP BY 1""")
def _(spark, sf):
    return panels.selection_audit(B.transactions(spark, sf), B.CUTOFF, (B.MARKET_A, B.MARKET_B), B.MARKET_B)


@query("e4_quarterly_median", "market s, q i, market_quarter_median f2, lagged_market_median_price f2",
       f"""WITH {B.TX}, m AS (SELECT market, year(sale_date) * 4 + quarter(sale_date) - 1 AS q,
       median(sale_price) AS market_quarter_median FROM tx GROUP BY 1, 2) SELECT *,
       lag(market_quarter_median) OVER (PARTITION BY market ORDER BY q) AS lagged_market_median_price FROM m""")
def _(spark, sf):
    return panels.quarterly_medians(B.transactions(spark, sf))


@query("e5_numeric_summary", "market s, median f2, p90 f2, maximum f2",
       f"""WITH {B.TX} SELECT market, median(sale_price) AS median, quantile_cont(sale_price, 0.9) AS p90,
       max(sale_price) AS maximum FROM tx GROUP BY 1""")
def _(spark, sf):
    return metrics.numeric_summary(B.transactions(spark, sf), ["market"], "sale_price")


@query("e6_observation_end", "market s, observation_end d",
       f"""WITH {B.TX} SELECT market, max(sale_date) AS observation_end FROM tx WHERE sale_price >= 10000
       AND sale_date <= CASE market WHEN 'market_a' THEN DATE '2000-05-05' ELSE DATE '2020-01-01' END GROUP BY 1""")
def _(spark, sf):
    allowed = spark.createDataFrame(
        [(B.MARKET_A, "2000-05-05"), (B.MARKET_B, "2020-01-01")], "market string, latest string"
    ).withColumn("latest", F.to_date("latest"))
    return linkage.observation_end(B.transactions(spark, sf), allowed)


_KM_SQL = """, kmn AS (SELECT market, operator, hold_days AS t, count(*) AS n,
 count(*) FILTER (event_observed) AS d FROM epanel GROUP BY 1, 2, 3),
kmr AS (SELECT *, sum(n) OVER (PARTITION BY market, operator ORDER BY t DESC ROWS UNBOUNDED PRECEDING)
 AS at_risk FROM kmn),
kms AS (SELECT *, product(1 - d / at_risk) OVER (PARTITION BY market, operator ORDER BY t
 ROWS UNBOUNDED PRECEDING) AS s FROM kmr),
km AS (SELECT market, operator, min(t) FILTER (d > 0 AND s <= 0.5) AS km_median_exit_days,
 1 - coalesce(min(s) FILTER (d > 0 AND t <= 90), 1) AS km_exit_probability_90d,
 1 - coalesce(min(s) FILTER (d > 0 AND t <= 120), 1) AS km_exit_probability_120d FROM kms GROUP BY 1, 2)"""


@query("e7_episode_summary", "market s, operator s, n_acquisitions i, n_unique_parcels i, "
       "n_observed_exits i, observed_exit_share f9, acquisition_start d, acquisition_end d, "
       "median_observed_hold_days f2, km_median_exit_days f2, km_exit_probability_90d f9, "
       "km_exit_probability_120d f9, median_gross_spread f2, median_gross_return f8",
       f"""WITH {B.EPISODE_PANEL}{_KM_SQL}, s AS (SELECT market, operator, count(*) AS n_acquisitions,
       count(DISTINCT parcel_id) AS n_unique_parcels, count(*) FILTER (event_observed) AS n_observed_exits,
       count(*) FILTER (event_observed) / count(*) AS observed_exit_share,
       min(acquisition_date) AS acquisition_start, max(acquisition_date) AS acquisition_end,
       median(hold_days) FILTER (event_observed) AS median_observed_hold_days,
       median(gross_spread) AS median_gross_spread, median(gross_return) AS median_gross_return
       FROM epanel GROUP BY 1, 2) SELECT * FROM s JOIN km USING (market, operator)""")
def _(spark, sf):
    return survival.episode_summary(_episode_panel(spark, sf))


@query("e8_operator_support", "operator s, minimum_support i",
       f"""WITH {B.EPISODE_PANEL}{_SUPPORT_SQL} SELECT * FROM support WHERE minimum_support >= 25""")
def _(spark, sf):
    return splits.supported_operators(_comparable(spark, sf), (B.MARKET_A, B.MARKET_B), 25)


_SCORED_SQL = """, scored AS (SELECT market, parcel_id, sale_price AS y, rolled_forward_prior_baseline AS p,
 rolled_forward_prior_baseline * 0.8::DOUBLE AS lo, rolled_forward_prior_baseline * 1.25::DOUBLE AS hi,
 count(*) OVER (PARTITION BY market, parcel_id) AS n_rows FROM repeats),
 weighted AS (SELECT *, 1 / n_rows / sum(1 / n_rows) OVER (PARTITION BY market) AS w, abs(p - y) AS ae,
 abs(p - y) / y AS ape, hi - lo AS width FROM scored),
 cumw AS (SELECT *, sum(w) OVER (PARTITION BY market ORDER BY ae) AS cae,
 sum(w) OVER (PARTITION BY market ORDER BY ape) AS cape,
 sum(w) OVER (PARTITION BY market ORDER BY width) AS cwidth FROM weighted)"""


def _scored(spark, sf):
    baseline = F.col("rolled_forward_prior_baseline")
    return _repeats(spark, sf).withColumns(
        {"prediction": baseline, "lower": baseline * 0.8, "upper": baseline * 1.25})


@query("e9_weighted_valuation_metrics", "market s, n_transactions i, n_parcels i, mean_absolute_error f3, "
       "root_mean_squared_error f3, median_absolute_error f3, mean_absolute_percentage_error f8, "
       "median_absolute_percentage_error f8, mean_error f3, weighted_r_squared f7, interval_coverage f8, "
       "median_interval_width f3",
       f"""WITH {B.REPEAT}{_SCORED_SQL} SELECT market, count(*) AS n_transactions,
       count(DISTINCT parcel_id) AS n_parcels, sum(w * ae) AS mean_absolute_error,
       sqrt(sum(w * ae * ae)) AS root_mean_squared_error,
       min(ae) FILTER (cae + 1e-9 >= 0.5) AS median_absolute_error,
       sum(w * ape) AS mean_absolute_percentage_error,
       min(ape) FILTER (cape + 1e-9 >= 0.5) AS median_absolute_percentage_error, sum(w * (p - y)) AS mean_error,
       1 - sum(w * ae * ae) / (sum(w * y * y) - sum(w * y) * sum(w * y)) AS weighted_r_squared,
       sum(w * CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END) AS interval_coverage,
       min(width) FILTER (cwidth + 1e-9 >= 0.5) AS median_interval_width FROM cumw GROUP BY 1""")
def _(spark, sf):
    return metrics.weighted_valuation_metrics(_scored(spark, sf), ["market"])


@query("e10_weighted_median", "o_orderpriority s, weighted_median f2",
       """WITH c AS (SELECT o_orderpriority, o_totalprice AS v, sum(1 + o_orderkey % 5) OVER (
       PARTITION BY o_orderpriority ORDER BY o_totalprice) / sum(1 + o_orderkey % 5) OVER (
       PARTITION BY o_orderpriority) AS cw FROM orders)
       SELECT o_orderpriority, min(v) FILTER (cw + 1e-9 >= 0.5) AS weighted_median FROM c GROUP BY 1""")
def _(spark, sf):
    orders = B.read(spark, sf, "orders").withColumn("w", 1 + F.col("o_orderkey") % 5)
    return scale.weighted_quantiles(orders, ["o_orderpriority"], "o_totalprice", "w", {"weighted_median": 0.5})


_HAZ = "n_risk_rows i, n_events_within_horizon i, n_episodes i, n_parcels i, person_period_brier_score f9, " \
       "constant_hazard_brier_score f9, brier_skill_score f9, person_period_log_loss f9, " \
       "observed_person_period_hazard f9, mean_predicted_person_period_hazard f9"


@query("e11_hazard_metrics", "grp s, " + _HAZ,
       f"""WITH {B.PROBS} SELECT grp, count(*) AS n_risk_rows, sum(y) AS n_events_within_horizon,
       count(DISTINCT episode) AS n_episodes, count(DISTINCT parcel) AS n_parcels,
       avg((p - y) * (p - y)) AS person_period_brier_score,
       avg((0.3::DOUBLE - y) * (0.3::DOUBLE - y)) AS constant_hazard_brier_score,
       1 - avg((p - y) * (p - y)) / avg((0.3::DOUBLE - y) * (0.3::DOUBLE - y)) AS brier_skill_score,
       avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS person_period_log_loss,
       avg(y) AS observed_person_period_hazard, avg(p) AS mean_predicted_person_period_hazard
       FROM (SELECT grp, y, episode, parcel, least(greatest(p, 1e-9), 1 - 1e-9) AS p FROM probs) GROUP BY 1""")
def _(spark, sf):
    return metrics.hazard_metrics(B.probabilities(spark, sf), ["grp"], probability="p", outcome="y",
                                  training_rate=0.3, episode="episode", parcel="parcel")


@query("e12_roc_auc", "grp s, risk_row_auc f9",
       f"""WITH {B.PROBS}, r AS (SELECT grp, y, rank() OVER w + (count(*) OVER (PARTITION BY grp, p) - 1) / 2 AS rk
       FROM probs WINDOW w AS (PARTITION BY grp ORDER BY p))
       SELECT grp, (sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))
       AS risk_row_auc FROM r GROUP BY 1""")
def _(spark, sf):
    return metrics.roc_auc(B.probabilities(spark, sf), ["grp"], score="p", outcome="y")


@query("e13_km_estimates", "market s, operator s, km_median_exit_days f2, km_exit_probability_90d f9, "
       "km_exit_probability_120d f9",
       f"WITH {B.EPISODE_PANEL}{_KM_SQL} SELECT * FROM km")
def _(spark, sf):
    return survival.km_estimates(_episode_panel(spark, sf), ["market", "operator"])


@query("e14_binary_scores", "grp s, n i, brier_score f9, baseline_brier f9, log_loss f9, baseline_log_loss f9",
       f"""WITH {B.PROBS}, rate AS (SELECT period, avg(y) AS b FROM probs GROUP BY 1) SELECT grp, count(*) AS n,
       avg((p - y) * (p - y)) AS brier_score, avg((b - y) * (b - y)) AS baseline_brier,
       avg(-(y * ln(least(p, 1 - 1e-9)) + (1 - y) * ln(1 - least(p, 1 - 1e-9)))) AS log_loss,
       avg(-(y * ln(b) + (1 - y) * ln(1 - b))) AS baseline_log_loss
       FROM probs JOIN rate USING (period) GROUP BY 1""")
def _(spark, sf):
    rows = B.probabilities(spark, sf)
    return metrics.binary_scores(metrics.rate_lookup(rows, metrics.period_rate(rows, "period", "y")), ["grp"])


@query("e15_calibration_error", "grp s, expected_calibration_error f9",
       f"""WITH {B.PROBS}, b AS (SELECT grp, least(floor(p * 10), 9) AS bin, count(*) AS n,
       abs(avg(p) - avg(y)) AS gap FROM probs GROUP BY 1, 2)
       SELECT grp, sum(n * gap) / sum(n) AS expected_calibration_error FROM b GROUP BY 1""")
def _(spark, sf):
    return metrics.calibration_error(B.probabilities(spark, sf), ["grp"])


@query("e16_anchor_metrics", "market s, evaluation_rows i, median_absolute_error f2, mean_absolute_error f2, "
       "wape f8, median_absolute_percentage_error f8, interval_coverage f8, median_interval_width_rate f6, "
       "pooled_median_baseline_mae f2, mae_improvement_over_pooled_median f7",
       f"""WITH {B.REPEAT}{_SCORED_SQL}, m AS (SELECT median(y) AS pooled FROM scored),
       z AS (SELECT *, abs(y - pooled) AS naive FROM weighted, m)
       SELECT market, count(*) AS evaluation_rows, median(ae) AS median_absolute_error,
       avg(ae) AS mean_absolute_error, sum(ae) / sum(y) AS wape, median(ape) AS median_absolute_percentage_error,
       avg(CASE WHEN y BETWEEN lo AND hi THEN 1 ELSE 0 END) AS interval_coverage,
       median(width / p) AS median_interval_width_rate, avg(naive) AS pooled_median_baseline_mae,
       1 - avg(ae) / avg(naive) AS mae_improvement_over_pooled_median FROM z GROUP BY 1""")
def _(spark, sf):
    scored = _scored(spark, sf).select("market", "sale_price", "prediction", "lower", "upper")
    pooled = scale.exact_percentiles(scored, [], "sale_price", {"pooled": 0.5})
    return metrics.anchor_metrics(scale.attach_row(scored, pooled), ["market"], actual="sale_price",
                                  prediction="prediction", lower="lower", upper="upper", pooled="pooled")


@query("e17_split_audit", "split s, raw_rows i, kept_rows i, kept_parcels i, purged_rows i, purged_parcels i",
       f"""WITH {B.REPEAT}{_SPLIT_SQL} SELECT split, count(*) AS raw_rows, count(*) FILTER (kept) AS kept_rows,
       count(DISTINCT parcel_id) FILTER (kept) AS kept_parcels, count(*) FILTER (NOT kept) AS purged_rows,
       count(DISTINCT parcel_id) FILTER (NOT kept) AS purged_parcels FROM labelled GROUP BY 1""")
def _(spark, sf):
    return splits.split_audit(_split(spark, sf))


@query("e18_policy_scorecard", _CARD_COLUMNS, f"WITH {_CARD_SQL} SELECT * FROM card")
def _(spark, sf):
    return metrics.policy_scorecard(B.backtest(spark, sf))


_TAIL_SQL = """, t AS (SELECT dist_id, sum(greatest(0, least(upto, 0.1::DOUBLE) - (upto - p)) * greatest(-profit, 0))
 / 0.1::DOUBLE AS downside_cvar_loss, sum(greatest(0, least(upto, 0.1::DOUBLE) - (upto - p)) * profit) / 0.1::DOUBLE
 AS lower_tail_mean, min(profit) FILTER (upto + 1e-9 >= 0.5) AS q50, min(profit) AS q00 FROM cum GROUP BY 1)"""


@query("e19_downside_cvar", "dist_id i, downside_cvar_loss f6",
       f"WITH {B.DISTRIBUTIONS}{_TAIL_SQL} SELECT * FROM t")
def _(spark, sf):
    return risk.tail_statistics(B.distributions(spark, sf), ["dist_id"])


@query("e20_lower_tail_mean", "dist_id i, lower_tail_mean f6",
       f"WITH {B.DISTRIBUTIONS}{_TAIL_SQL} SELECT * FROM t")
def _(spark, sf):
    return risk.tail_statistics(B.distributions(spark, sf), ["dist_id"])


@query("e21_weighted_quantile", "dist_id i, q00 f6, q50 f6",
       f"WITH {B.DISTRIBUTIONS}{_TAIL_SQL} SELECT * FROM t")
def _(spark, sf):
    return risk.tail_statistics(B.distributions(spark, sf), ["dist_id"], quantiles={"q00": 0.0, "q50": 0.5})


@query("e22_normalize_distribution", "dist_id i, event_id i, p f9, profit f6, expected_profit f6",
       f"""WITH {B.DISTRIBUTIONS} SELECT dist_id, event_id, p, profit,
       sum(p * profit) OVER (PARTITION BY dist_id) AS expected_profit FROM dist""")
def _(spark, sf):
    atoms = risk.normalize_distribution(B.distributions(spark, sf), ["dist_id"])
    return scale.join_on(atoms, risk.expected_profit(B.distributions(spark, sf), ["dist_id"]), ["dist_id"])


@query("e23_compress_distribution", "dist_id i, bin i, p f9, profit f6",
       f"""WITH {B.DISTRIBUTIONS}, k AS (SELECT *, count(*) OVER (PARTITION BY dist_id) AS atoms,
       row_number() OVER (PARTITION BY dist_id ORDER BY profit, event_id) AS rk FROM cum),
       b AS (SELECT *, unnest(CASE WHEN atoms <= 10 THEN [rk - 1] ELSE range(CAST(floor((upto - p) * 10 + 1e-9) AS BIGINT),
        greatest(CAST(floor((upto - p) * 10 + 1e-9) AS BIGINT),
         least(CAST(ceil(upto * 10 - 1e-9) AS BIGINT) - 1, 9)) + 1) END) AS bin FROM k),
       m AS (SELECT *, CASE WHEN atoms <= 10 THEN p ELSE least(upto, (bin + 1) / 10::DOUBLE)
        - greatest(upto - p, bin / 10::DOUBLE) END AS mass FROM b)
       SELECT dist_id, bin, sum(mass) AS p, sum(mass * profit) / sum(mass) AS profit FROM m
       WHERE mass > 1e-12 GROUP BY 1, 2""")
def _(spark, sf):
    return risk.compress_distribution(B.distributions(spark, sf), ["dist_id"], 10, ["event_id"])


@query("e24_loss_probability", "dist_id i, loss_probability f9",
       f"""WITH {B.DISTRIBUTIONS} SELECT dist_id, coalesce(sum(p) FILTER (profit < 0), 0) AS loss_probability
       FROM dist GROUP BY 1""")
def _(spark, sf):
    return risk.expected_profit(B.distributions(spark, sf), ["dist_id"])


@query("e25_conformal_radius", "n_scores i, interval_radius f9",
       f"""WITH {B.REPEAT}, s AS (SELECT parcel_id, max(abs(ln(sale_price / rolled_forward_prior_baseline))) AS r
       FROM repeats GROUP BY 1), k AS (SELECT r, row_number() OVER (ORDER BY r) AS rk, count(*) OVER () AS n FROM s)
       SELECT max(n) AS n_scores, min(r) FILTER (rk = least(n, ceil((n + 1) * 0.9::DOUBLE) + 1)) AS interval_radius FROM k""")
def _(spark, sf):
    gap = F.ln(F.col("sale_price") / F.col("rolled_forward_prior_baseline"))
    return conformal.conformal_radius(_repeats(spark, sf).withColumn("residual", gap))


@query("e26_period_rate", "period i, rate f9",
       f"""WITH {B.PROBS} SELECT period, avg(y) AS rate FROM probs GROUP BY 1
       UNION ALL SELECT NULL, avg(y) FROM probs""")
def _(spark, sf):
    return metrics.period_rate(B.probabilities(spark, sf), "period", "y")


@query("e27_latest_training_exit", "latest_exit d, truncated i, dropped i",
       f"""WITH {B.UNITS}, u AS (SELECT *, date_diff('day', acquisition_date, DATE '2002-01-01') AS fu FROM units),
       c AS (SELECT acquisition_date, hold_days >= fu AS cut, CASE WHEN hold_days >= fu THEN fu ELSE hold_days END AS h,
        event_observed AND hold_days < fu AS ev, CASE WHEN hold_days >= fu THEN floor(fu / 7) ELSE duration_weeks END AS w FROM u)
       SELECT max(acquisition_date + CAST(h AS INTEGER)) FILTER (ev) AS latest_exit, count(*) FILTER (cut) AS truncated,
       count(*) FILTER (NOT (ev OR w >= 1)) AS dropped FROM c""")
def _(spark, sf):
    return survival.followup_audit(B.units(spark, sf), "2002-01-01")


@query("e28_relative_gain", "market s, relative_gain f8",
       f"""WITH {B.REPEAT}{_SCORED_SQL} SELECT market, 1 - sum(w * abs(p * 0.98::DOUBLE - y)) / sum(w * ae)
       AS relative_gain FROM weighted GROUP BY 1""")
def _(spark, sf):
    scored = _scored(spark, sf)
    shrunk = scored.withColumn("prediction", F.col("prediction") * 0.98)
    return metrics.relative_gain(metrics.weighted_means(shrunk, ["market"]),
                                 metrics.weighted_means(scored, ["market"]), ["market"])


# --------------------------------------------------------------------------------------- windows

@query("f1_prior_sale", "parcel_id s, sale_date d, seq i, prior_sale_date d, prior_sale_price f2",
       f"""WITH {B.TX} SELECT parcel_id, sale_date, seq, lag(sale_date) OVER w AS prior_sale_date,
       lag(sale_price) OVER w AS prior_sale_price FROM tx
       WINDOW w AS (PARTITION BY market, parcel_id ORDER BY sale_date, seq, sale_price)""")
def _(spark, sf):
    return panels.with_prior_sale(B.transactions(spark, sf))


@query("f2_lagged_quarter_median", "market s, q i, lagged_market_median_price f2",
       f"WITH {B.PANEL} SELECT * FROM medlag")
def _(spark, sf):
    universe = panels.analysis_universe(B.transactions(spark, sf), B.CUTOFF, B.MARKET_B)
    eligible = panels.valuation_screen(universe, require_qualified=False)
    return panels.quarterly_medians(eligible.select(*panels.SALE_KEY).distinct())


@query("f3_dedupe_keep_last", "parcel_id s, sale_date d, sale_price f2, seq i",
       f"""WITH {B.TX} SELECT * FROM tx QUALIFY row_number() OVER (
       PARTITION BY market, parcel_id, sale_date, sale_price ORDER BY seq DESC) = 1""")
def _(spark, sf):
    return panels.dedupe_keep_last(B.transactions(spark, sf))


@query("f4_dedupe_deeds", "parcel_id s, sale_date d, sale_price f2, buyer_operator s, seller_operator s, seq i",
       f"""WITH {B.TX} SELECT * FROM tx QUALIFY row_number() OVER (PARTITION BY parcel_id, market, sale_date,
       sale_price, buyer_operator, seller_operator ORDER BY seq) = 1""")
def _(spark, sf):
    return linkage.dedupe_deeds(B.transactions(spark, sf))


@query("f5_strict_prior_quarter", "parcel_id s, sale_date d, seq i, prior_sale_date d",
       f"WITH {B.PANEL} SELECT * FROM panel")
def _(spark, sf):
    return B.panel(spark, sf)


@query("f6_km_curve", "market s, operator s, week f6, exit_probability f9",
       f"""WITH {B.EPISODE_PANEL}{_KM_SQL} SELECT market, operator, t / 7 AS week, 1 - s AS exit_probability
       FROM kms WHERE d > 0 AND t <= 365 UNION ALL SELECT DISTINCT market, operator, 0, 0 FROM kms""")
def _(spark, sf):
    return survival.km_curve(_episode_panel(spark, sf), ["market", "operator"])


_CURVE_SQL = """, haz AS (SELECT unit, period, 0.02::DOUBLE + (unit % 11) / 100::DOUBLE + period / 400::DOUBLE AS hazard
 FROM units, (SELECT unnest(range(1, 13)) AS period)),
curve AS (SELECT *, product(1 - hazard) OVER (PARTITION BY unit ORDER BY period ROWS UNBOUNDED PRECEDING)
 AS survival FROM haz)"""


def _hazards(spark, sf):
    grid = survival.horizon_grid(B.units(spark, sf).select("unit"), 12)
    return grid.withColumn("hazard", 0.02 + F.col("unit") % 11 / 100 + F.col("period") / 400)


@query("f7_survival_curve", "unit i, period i, survival f9", f"WITH {B.UNITS}{_CURVE_SQL} SELECT * FROM curve")
def _(spark, sf):
    return survival.survival_curve(_hazards(spark, sf), ["unit"])


@query("f8_parcel_weights", "parcel_id s, unit i, weight f15",
       f"""WITH {B.UNITS} SELECT parcel_id, unit, 1 / (count(*) OVER (PARTITION BY parcel_id)
       * (SELECT count(DISTINCT parcel_id) FROM units)) AS weight FROM units""")
def _(spark, sf):
    return metrics.parcel_weights(B.units(spark, sf))


@query("f9_date_cutoffs", "n_dates i, calibration_start d, test_start d",
       """WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos, count(*) OVER () AS n
       FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))
       SELECT max(n) AS n_dates, max(day) FILTER (pos = floor(n * (1 - 0.2::DOUBLE - 0.2::DOUBLE))) AS calibration_start,
       max(day) FILTER (pos = floor(n * (1 - 0.2::DOUBLE))) AS test_start FROM d""")
def _(spark, sf):
    return splits.date_cutoff_table(B.read(spark, sf, "orders"), "o_orderdate")


@query("f10_median_period", "unit i, median_period i",
       f"""WITH {B.UNITS}{_CURVE_SQL} SELECT unit, coalesce(min(period) FILTER (1 - survival >= 0.5), 13)
       AS median_period FROM curve GROUP BY 1""")
def _(spark, sf):
    return survival.median_period(survival.survival_curve(_hazards(spark, sf), ["unit"]), ["unit"], 12)


@query("f11_even_sample", "o_orderkey i, position i",
       """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
       count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, position FROM p WHERE position IN (
        SELECT CAST(floor(i * ((SELECT max(n) FROM p) - 1) / 199::DOUBLE) AS BIGINT) FROM range(0, 200) r(i))""")
def _(spark, sf):
    return conformal.even_sample(B.read(spark, sf, "orders"), 200, ["o_orderdate", "o_orderkey"])


@query("f12_zscore", "property_id i, balance_z f8, value_z f8, constant_z f8",
       f"""WITH {B.LEADS} SELECT property_id, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS balance_z,
       (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value_z, 0 AS constant_z FROM leads""")
def _(spark, sf):
    rows = B.leads(spark, sf).withColumn("constant", F.lit(3.0))
    return metrics.zscores(rows, ["balance", "value", "constant"])


@query("f13_sale_by_horizon", "unit i, event_probability f9",
       f"WITH {B.UNITS}{_CURVE_SQL} SELECT unit, 1 - product(1 - hazard) AS event_probability FROM haz GROUP BY 1")
def _(spark, sf):
    return survival.horizon_probability(_hazards(spark, sf), ["unit"])


# ------------------------------------------------------------------------- order, sets, expansion

@query("g1_canonical_order", "position i, operator s, parcel_id s, acquisition_date d",
       f"""WITH {B.EPISODES} SELECT row_number() OVER (ORDER BY market, operator, acquisition_date, parcel_id,
       acquisition_price, hold_days, linkage_status) - 1 AS position, operator, parcel_id, acquisition_date FROM episodes""")
def _(spark, sf):
    order = ["market", "operator", "acquisition_date", "parcel_id", "acquisition_price", "hold_days", "linkage_status"]
    return scale.rank_positions(B.episode_table(spark, sf).select(*order), order, "position")


@query("h1_concat_partitions", "parcel_id s, sale_date d, seq i",
       f"""WITH {B.REPEAT}{_SPLIT_SQL} SELECT * FROM labelled WHERE kept AND split IN ('training', 'calibration')""")
def _(spark, sf):
    return splits.concat_partitions(_split(spark, sf), "training", "calibration")


@query("h2_key_overlap", "market s, parcel_id s",
       f"""WITH {B.TX} SELECT DISTINCT market, parcel_id FROM tx WHERE buyer_operator = 'opendoor' INTERSECT
       SELECT market, parcel_id FROM tx WHERE seller_operator = 'zillow_offers'""")
def _(spark, sf):
    sales = B.transactions(spark, sf)
    return splits.key_overlap(sales.filter("buyer_operator = 'opendoor'"),
                              sales.filter("seller_operator = 'zillow_offers'"))


@query("h3_missing_markets", "market s",
       """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS market FROM orders EXCEPT
       SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0""")
def _(spark, sf):
    required = B.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("market"))
    provided = B.read(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("market"))
    return linkage.missing_markets(required, provided)


@query("i1_person_period", "unit i, period i, event i",
       f"""WITH {B.UNITS} SELECT unit, period, CASE WHEN event_observed AND period = duration_weeks THEN 1 ELSE 0 END
       AS event FROM (SELECT *, unnest(range(1, least(duration_weeks, 26) + 1)) AS period FROM units WHERE duration_weeks >= 1)""")
def _(spark, sf):
    return survival.person_period(B.units(spark, sf), max_periods=26)


@query("i2_survival_panel", "period i, at_risk i, events i",
       f"""WITH {B.UNITS} SELECT period, count(*) AS at_risk, count(*) FILTER (event_observed AND period = duration_weeks)
       AS events FROM (SELECT *, unnest(range(1, duration_weeks + 1)) AS period FROM units WHERE duration_weeks >= 1) GROUP BY 1""")
def _(spark, sf):
    rows = survival.survival_panel(B.units(spark, sf), "duration_weeks", "event_observed")
    return rows.groupBy("period").agg(F.sum("at_risk").alias("at_risk"), F.sum("event").alias("events"))


@query("i3_horizon_grid", "unit i, period i",
       "SELECT o_orderkey AS unit, unnest(range(1, 9)) AS period FROM orders")
def _(spark, sf):
    return survival.horizon_grid(B.units(spark, sf), 8)


@query("i4_admin_censor", "unit i, hold_days i, duration_weeks i, event_observed b, truncated b",
       f"""WITH {B.UNITS}, u AS (SELECT *, date_diff('day', acquisition_date, DATE '2002-01-01') AS fu FROM units),
       c AS (SELECT unit, hold_days >= fu AS truncated, least(hold_days, fu) AS hold_days,
        event_observed AND hold_days < fu AS event_observed,
        CASE WHEN hold_days >= fu THEN CAST(floor(fu / 7) AS BIGINT) ELSE duration_weeks END AS duration_weeks FROM u)
       SELECT * FROM c WHERE event_observed OR duration_weeks >= 1""")
def _(spark, sf):
    return survival.admin_censor(B.units(spark, sf), "2002-01-01")


@query("j9_rare_category_bucket", "bucket s, n i",
       """WITH c AS (SELECT p_name, count(*) AS k FROM part GROUP BY 1), b AS (
       SELECT CASE WHEN k < 25 THEN '__rare__' ELSE p_name END AS bucket FROM part JOIN c USING (p_name))
       SELECT bucket, count(*) AS n FROM b GROUP BY 1""")
def _(spark, sf):
    parts = B.read(spark, sf, "part")
    bucketed = splits.bucket_rare(parts, parts, "p_name", minimum=25)
    return metrics.group_counts(bucketed, ["bucket"])


@query("j10_grouped_split", "parcel_id s, is_calibration b, n i",
       f"""WITH {B.UNITS} SELECT parcel_id, CAST('0x' || substr(md5('7:' || parcel_id), 1, 8) AS BIGINT)
       / 4294967296::DOUBLE < 0.2::DOUBLE AS is_calibration, count(*) AS n FROM units GROUP BY ALL""")
def _(spark, sf):
    return metrics.group_counts(splits.grouped_split(B.units(spark, sf), "parcel_id", 0.2, 7),
                                ["parcel_id", "is_calibration"])
