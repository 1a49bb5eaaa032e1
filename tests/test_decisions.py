"""Decision jobs against small hand-checked cases and a plain recursive solver."""

import math

import pytest
from pyspark.sql import functions as F

from homespell.functions import pricing as P
from homespell.operators import decisions as D
from homespell.operators import risk
from homespell.operators.markdown import markdown_dp


def _lead(spark, **values):
    base = dict(lead_id="x", reference=100.0, prelisting_reference=100.0, list_price=100.0, offer=70.0,
                repair_cost=0.0, weekly_holding_cost=0.0, cost_rate=0.0, fixed_cost=0.0,
                acquisition_cost=0.0, prelisting_weeks=0, base_probability=0.3, elasticity=8.0,
                dom_per_week=0.0, demand_shift=0.0, negotiation_discount=0.005, risk_aversion=0.0,
                liquidation_discount=0.92)
    base.update(values)
    return spark.createDataFrame([base]).withColumn("scenarios", D._scenario_array(
        values.get("scenario_rows", (("soft", 0.3, 0.9, 0.7), ("base", 0.7, 1.0, 1.0)))))


def _solve(lead, scenarios, horizon, floor_ratio=0.7, alpha=0.1):
    """Recursive reference solution for one lead."""
    memo = {}

    def profit(price, week):
        held = lead["prelisting_weeks"] + week + 1
        return (price - lead["offer"] - lead["repair_cost"] - lead["acquisition_cost"]
                - lead["fixed_cost"] - lead["cost_rate"] * price - held * lead["weekly_holding_cost"])

    def cvar(atoms):
        left, loss = alpha, 0.0
        for value, mass in sorted(atoms):
            take = min(mass, left)
            loss, left = loss + take * max(-value, 0), left - take
        return loss / alpha

    def node(week, cents):
        if (week, cents) in memo:
            return memo[week, cents]
        best = None
        for name, cut in P.ACTIONS:
            price = round(cents / 100 * (1 - cut), 2)
            if name != "hold" and price < lead["prelisting_reference"] * floor_ratio:
                continue
            outcomes = []
            for _, q, vm, dm in scenarios:
                value = lead["reference"] * vm
                z = (math.log(lead["base_probability"] / (1 - lead["base_probability"]))
                     - lead["elasticity"] * (price / value - 1) + lead["dom_per_week"] * week + math.log(dm)
                     + lead["demand_shift"])
                outcomes.append((q, 1 / (1 + math.exp(-z)), min(price * (1 - 0.005), value)))
            sold = sum(q * h for q, h, _ in outcomes)
            atoms = [(profit(v, week), q * h) for q, h, v in outcomes]
            if week + 1 < horizon:
                atoms += [(v, m * (1 - sold)) for v, m in node(week + 1, round(price * 100))[3]]
            else:
                atoms += [(profit(v * lead["liquidation_discount"], week), q * (1 - h)) for q, h, v in outcomes]
            mean = sum(v * m for v, m in atoms)
            objective = mean - lead["risk_aversion"] * cvar(atoms)
            if best is None or objective > best[0] + 1e-9:
                best = (objective, name, round(price * 100), atoms)
        memo[week, cents] = best
        return best

    node(0, round(lead["list_price"] * 100))
    return memo


@pytest.mark.parametrize("changes,horizon", [
    ({}, 1), (dict(risk_aversion=0.6, offer=97.0, weekly_holding_cost=0.8), 4),
    (dict(list_price=72.3, risk_aversion=0.3, offer=80.0, elasticity=20.0), 5),
])
def test_dynamic_program_matches_recursion(spark, changes, horizon):
    scenarios = (("soft", 0.3, 0.9, 0.7), ("base", 0.7, 1.0, 1.0))
    df = _lead(spark, **changes)
    config = D.PricingConfig(horizon_weeks=horizon)
    got = {(r.week, r.state_cents): r for r in D.decision_table(
        markdown_dp(df, config)).collect()}
    expected = _solve(df.first().asDict(), scenarios, horizon)
    assert set(got) == set(expected)
    for key, (objective, action, cents, _) in expected.items():
        assert got[key].objective == pytest.approx(objective, abs=1e-7)
        assert (got[key].action, got[key].cents) == (action, cents)


def test_fixed_policy_is_the_program_with_one_action(spark):
    df = _lead(spark, weekly_holding_cost=0.5, risk_aversion=0.4, offer=95.0)
    config = D.PricingConfig(horizon_weeks=6)
    held = D.evaluate_policy(df, D.hold_cuts(6), config).first()
    best = markdown_dp(df, config).first()
    assert sum(a.p for a in held.atoms) == pytest.approx(1.0)
    assert best.objective >= held.objective - 1e-9
    assert sum(a.p for a in best.atoms) == pytest.approx(1.0)


def test_path_follows_decisions(spark):
    solved = markdown_dp(_lead(spark), D.PricingConfig(horizon_weeks=3))
    path = solved.first().no_sale_path
    assert [d.week for d in path] == [0, 1, 2]
    assert all(a.cents == b.state_cents for a, b in zip(path, path[1:], strict=False))


def test_contribution_profit(spark):
    value = spark.range(1).select(P.contribution_profit(
        F.lit(100.0), F.lit(50.0), F.lit(10.0), F.lit(3.0), F.lit(5.0), F.lit(.1), F.lit(1), F.lit(1), F.lit(2.0)))
    assert value.first()[0] == pytest.approx(16.0)


def test_offer_choice(spark):
    grid = spark.createDataFrame([("x", 60.0, .1), ("x", 80.0, .9)], "lead string, offer double, acceptance double")
    atoms = F.array(F.struct((100 - F.col("offer")).alias("profit"), F.lit(1.0).alias("p")))
    quoted = D.quote(grid.withColumns({"atoms": atoms, "expected_profit": 100 - F.col("offer"),
                                       "risk_aversion": F.lit(0.0)}))
    assert sorted(r.objective for r in quoted.collect()) == [pytest.approx(4.0), pytest.approx(18.0)]
    assert D.best_offer(quoted.drop("atoms", "exit_atoms"), "lead").first().offer == 80.0
    assert spark.range(1).select(P.fixed_spread_offer(F.lit(100.0), 0.1)).first()[0] == 90.0


def test_long_distributions_are_folded(spark):
    """A limit folds the distribution like the long form does; the mean stays."""
    df = _lead(spark, weekly_holding_cost=0.5, risk_aversion=0.4, offer=95.0)
    whole, few = (D.evaluate_policy(df, D.hold_cuts(70), D.PricingConfig(70, max_distribution_points=n)).first() for n in (10_000, 20))
    assert len(whole.atoms) > 20 and len(few.atoms) == 20
    assert few.expected_profit == pytest.approx(whole.expected_profit)
    long = spark.createDataFrame([("x", a.profit, a.p) for a in whole.atoms], "k string, profit double, p double")
    folded = sorted(r.profit for r in risk.compress_distribution(long, ["k"], 20).collect())
    assert [a.profit for a in few.atoms] == pytest.approx(folded)
    exact, limited = (markdown_dp(df, D.PricingConfig(12, max_distribution_points=n)).first() for n in (10_000, 15))
    assert len(limited.atoms) <= 15 and limited.expected_profit == pytest.approx(exact.expected_profit, rel=0.02)


def test_nearest_of_many_templates(spark):
    templates = F.array(*[F.struct(F.lit(1000.0 * k).alias("template_reference"), F.lit(f"t{k}").alias("name")) for k in range(1, 151)])
    found = spark.range(1).select(D.nearest_template(F.lit(149_000.0), templates)["name"]).first()[0]
    assert found == "t149"


def test_outcomes_before_the_offers_give_the_same_policy(spark):
    config, cuts = D.PricingConfig(6), D.scheduled_cuts(6)
    leads = _lead(spark, risk_aversion=0.4).withColumns({
        "offers": F.array(F.lit(70.0), F.lit(85.0), F.lit(70.0)), "midpoint": F.lit(0.9), "slope": F.lit(28.0),
        "intercept": F.lit(0.0), "urgency": F.lit(0.1)})
    models = []

    def model(price, week, scenario):
        models.append(1)
        return D.elasticity_model(price, week, scenario)

    ahead = D.policy_outcomes(leads, cuts, config, model=model)
    assert ahead.select(F.size("_sales")).first()[0] == 14
    wanted = [r.asDict(recursive=True) for r in D.evaluate_policy(D.explode_offers(leads), cuts, config).orderBy("offer").collect()]
    made = D.evaluate_policy(D.explode_offers(ahead), cuts, config, model=model).orderBy("offer").collect()
    assert [r.asDict(recursive=True) for r in made] == wanted and [r["offer"] for r in wanted] == [70.0, 85.0]
    # The demand model was asked for once, with the leads and not with their offers.
    assert len(models) == 1
