"""The markdown program over a fitted hazard, and the request gate over the program."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from homespell.operators import decisions as D
from homespell.operators import markdown
from homespell.operators import models as M
from homespell.plans import decision_queries as Q

WEEKS = 4


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(1, 400_000.0, 12_000.0, 600.0, 0.0, 0.0), (2, 610_000.0, 10_000.0, 900.0, 0.3, 0.0), (3, 300_000.0, 9_000.0, 450.0, 0.3, 0.0),
            (4, 390_000.0, 12_000.0, 600.0, 0.3, 0.9), (5, 410_000.0, 200_000.0, 600.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "property_id long, value double, repair_cost double, weekly_holding_cost double, risk_aversion double, target_margin double")


def test_program_uses_the_hazards_of_the_scored_states(spark, requests):
    listings = spark.range(400).select(
        F.col("id").alias("unit"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("grp"),
        (F.col("id") % 46 / 100 - 0.30).alias("list_price_premium"), (1 + F.col("id") * 7 % WEEKS + F.col("id") % 2).cast("int").alias("duration_weeks"),
        (F.col("id") * 13 % 46 < 30).alias("event_observed"))
    model = M.fit_hazard(listings, M.FeatureSpec(("list_price_premium",), ("grp",)), WEEKS, "duration_weeks", "event_observed")
    homes = D.adapt_requests(requests).withColumn("grp", F.when(F.col("property_id") % 2 == 0, "a").otherwise("b"))
    config = D.PricingConfig(horizon_weeks=WEEKS)
    solved = markdown.markdown_dp(D.explode_offers(M.hazard_terms(model, homes, WEEKS, "grp")), config, lines=markdown.fitted_lines)
    found = solved.select("property_id", F.inline("decisions")).select("property_id", "week", "cents", "sale_probability").collect()
    states = M.score_states(model, markdown.price_lattice(homes, config, "property_id"), homes.select("property_id", "grp", "prelisting_reference"), "property_id")
    hazard = {(r.property_id, r.week, r.cents): r.hazard for r in states.collect()}
    assert len({hazard[key] for key in hazard}) > 50
    for row in found:
        assert math.isclose(row.sale_probability, hazard[row.property_id, row.week, row.cents], rel_tol=1e-7)


def test_gate_over_the_program_returns_its_policy(requests):
    rows = {r.property_id: r for r in D.request_gate(requests, Q._optimized).collect()}
    solved = Q._optimized(D.explode_offers(D.adapt_requests(requests))).collect()
    path = {(r.property_id, round(r.offer, 2)): r.no_sale_path for r in solved}
    assert [rows[k].recommendation for k in (4, 5)] == ["review", "review"]
    assert any(r.recommendation == "price" for r in rows.values())
    for key, row in rows.items():
        if row.recommendation != "price":
            assert row.policy == [] and row.sale_by_120_days == 0
            continue
        own = path[key, row.acquisition_offer]
        assert [(p.week, p.action, p.list_price) for p in row.policy] == [(d.week, d.action, d.cents / 100) for d in own] and len(own) == 17
        assert row.sale_by_120_days == pytest.approx(1 - math.prod(1 - d.sale_probability for d in own), abs=1e-6)
        # The calendar of k5 is another policy.
        assert [d.action for d in own] != ["hold", "hold"] + ["cut_2_5_pct", "hold"] * 7 + ["cut_2_5_pct"]


def test_sparse_pick_follows_support_size_and_width(spark):
    """Few training rows, unusual size and a wide interval win, and only where the interval matters."""
    homes = spark.createDataFrame(
        [(4, "rare", 1500.0, 90.0, 105.0, 121.0, 100.0), (8, "rare", 6000.0, 90.0, 105.0, 121.0, 100.0), (3, "common", 1500.0, 90.0, 105.0, 121.0, 100.0),
         (5, "rare", 9000.0, 90.0, 100.0, 121.0, 100.0), (6, "rare", 9000.0, 104.0, 105.0, 121.0, 100.0), (7, "none", 1500.0, 90.0, 105.0, 300.0, 90.0)],
        "property_id int, submarket string, square_feet double, lower double, prediction double, upper double, reference double")
    training = spark.createDataFrame([("rare",)] * 3 + [("common",)] * 50, "submarket string")
    scored = D.sparse_support_score(homes, training)
    score = {r.property_id: r.sparse_score for r in scored.collect()}
    width = np.array([31 / 105, 31 / 105, 31 / 105, 31 / 100, 17 / 105, 210 / 105])
    size = np.log([1500.0, 6000.0, 1500.0, 9000.0, 9000.0, 1500.0])
    expected = -np.log1p([3, 3, 50, 3, 3, 0]) + 0.35 * abs((size - size.mean()) / size.std()) + 0.5 * (width - width.mean()) / width.std()
    assert [score[k] for k in (4, 8, 3, 5, 6, 7)] == pytest.approx(list(expected), abs=1e-6)
    binding = D.consequential_interval(F.col("lower"), F.col("prediction"), F.col("reference"))
    picks = D.sequential_picks(scored, "property_id", [("sparse", F.col("sparse_score"), binding), ("next", F.col("sparse_score"), binding)]).collect()
    assert {r.profile: r.property_id for r in picks} == {"sparse": 7, "next": max((4, 8, 3), key=score.get)}
