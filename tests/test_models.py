"""Estimators against closed forms and plain Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from homespell.operators import models as M
from homespell.operators import survival


def _newton(x, y, penalty):
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 0.0
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (p - y) + ridge @ beta)
    return beta


def test_logit_matches_penalized_newton(spark):
    rng = np.random.default_rng(4)
    ratio, group = rng.uniform(0.82, 1.02, 600), rng.integers(0, 3, 600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(30 * (ratio - 0.92) + group - 1)))).astype(int)
    df = spark.createDataFrame(
        [(float(r), f"g{g}", int(t)) for r, g, t in zip(ratio, group, y, strict=True)],
        "offer_ratio double, grp string, accepted int")
    model = M.fit_acceptance(df, M.FeatureSpec(("offer_ratio",), ("grp",)), regularization=2.0)
    x = np.column_stack([(ratio - ratio.mean()) / ratio.std(), *[(group == g) * 1.0 for g in range(3)]])
    expected = _newton(x, y, 2.0)
    assert model.coefficients == pytest.approx(expected[1:], abs=2e-3)
    curve = M.offer_curve(model, df, [0.86, 0.96])
    effect = M.response_effect(curve, 0.86, 0.96, truth=3.0).first()
    assert effect.increasing and effect.recovery_error < 1.0
    table = model.coefficient_table(spark).collect()
    assert [r.coefficient for r in table] == sorted((r.coefficient for r in table), reverse=True)


def test_unseen_and_missing_categories(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b")], "x double, c string")
    fitted = M.fit_features(df, M.FeatureSpec(("x",), ("c",)))
    new = spark.createDataFrame([(None, "zzz"), (1.0, None)], "x double, c string")
    rows = [list(r.features) for r in fitted.transform(new).select("features").collect()]
    assert rows[0][1:] == [0.0, 0.0] and rows[0][0] == pytest.approx(0.0)
    assert rows[1][1:] == [0.0, 1.0]


def test_operator_reference_level_is_dropped(spark):
    rng = np.random.default_rng(1)
    data = [(f"p{i}", ["b", "a", "c"][i % 3], float(rng.random()), int(rng.integers(1, 9)), bool(rng.random() < .6))
            for i in range(300)]
    spells = spark.createDataFrame(
        data, "parcel_id string, operator string, x double, duration_weeks int, event_observed boolean")
    effects = M.fit_operator_hazard(spells, M.FeatureSpec(("x",)), 8).effects(spark, "operator").collect()
    assert [(r.operator, r.reference) for r in effects] == [("a", True), ("b", False), ("c", False)]
    assert effects[0].hazard_odds_ratio == 1.0


@pytest.mark.parametrize("drop_first", [False, True])
def test_hazard_on_cells_is_the_logit_of_unit_periods(spark, drop_first):
    """Grouped Newton steps against plain ones over expanded rows; missing values and long spells included."""
    rng = np.random.default_rng(6)
    data = [(i, [None, "b", "a", "c"][rng.integers(0, 4)], None if i % 17 == 0 else float(rng.integers(0, 5)) / 4, int(rng.integers(0, 15)), bool(rng.random() < .7))
            for i in range(900)]
    spells = spark.createDataFrame(data, "unit int, grp string, x double, weeks int, exit boolean")
    model = M.fit_hazard(spells, M.FeatureSpec(("x",), ("grp",), drop_first), 9, "weeks", "exit", 1.5)
    rows = survival.person_period(spells, "weeks", "exit", 9).toPandas()
    x = rows.x.fillna(rows.x.median()).to_numpy()
    mode = rows.grp.value_counts().sort_index().idxmax()
    grp = rows.grp.fillna(mode)
    columns = [(x - x.mean()) / x.std()] + [(grp == g) * 1.0 for g in "abc"[drop_first:]] + [(rows.period == t) * 1.0 for t in range(1 + drop_first, 10)]
    expected = _newton(np.column_stack(columns), rows.event.to_numpy(), 1.5)
    assert (model.intercept, *model.coefficients) == pytest.approx(tuple(expected), abs=1e-6)
    scored = M.score_hazard(model, survival.person_period(spells, "weeks", "exit", 9)).toPandas().sort_values(["unit", "period"])
    z = np.column_stack([np.ones(len(x)), *columns]) @ expected
    plain = rows.assign(p=1 / (1 + np.exp(-z))).sort_values(["unit", "period"])
    assert scored.hazard.to_numpy() == pytest.approx(plain.p.to_numpy(), abs=1e-7)


def test_hazard_expands_no_unit(spark, monkeypatch):
    spells = spark.range(2_000).select((F.col("id") % 3).cast("string").alias("grp"), (F.col("id") % 150 + 1).cast("int").alias("weeks"),
                                       (F.col("id") % 2 == 0).alias("exit"), F.lit(1.0).alias("x"))
    cells = M.spell_cells(spells, M.FeatureSpec(("x",), ("grp",)), 156, "weeks", "exit")
    assert cells.count() <= 300 and cells.agg(F.sum("rows")).first()[0] == spells.agg(F.sum("weeks")).first()[0]
    monkeypatch.setattr(F, "explode", None)
    model = M.fit_hazard(spells, M.FeatureSpec(("x",), ("grp",)), 156, "weeks", "exit")
    assert len(model.coefficients) == 1 + 3 + 150


def test_linear_conformal_covers(spark):
    homes = spark.range(500).select(
        "id", (F.col("id") % 37 / 10).alias("x"),
        F.exp(F.col("id") % 37 / 10 + (F.col("id") * 7919 % 101 - 50) / 500).alias("price"))
    model = M.fit_linear_conformal(homes, "price", M.FeatureSpec(("x",)), row_key="id")
    scored = model.transform(homes)
    assert scored.filter("lower <= prediction AND prediction <= upper").count() == 500
    assert scored.filter("price BETWEEN lower AND upper").count() >= 430


def test_many_frequent_categories(spark):
    """Twice as many categories as an earlier limit; those below the count become one."""
    rows = spark.range(40_010).select(
        F.when(F.col("id") < 40_000, F.concat(F.lit("c"), F.col("id") % 20_000)).otherwise(F.concat(F.lit("rare"), "id")).alias("grp"),
        (F.col("id") % 7).cast("double").alias("x"))
    fitted = M.fit_features(rows, M.FeatureSpec(("x",), ("grp",), minimum_count=2))
    assert len(fitted.vocabulary["grp"]) == 20_001 and "__rare__" in fitted.vocabulary["grp"]
    assert fitted.transform(rows).count() == 40_010


def test_categories_stay_where_they_are(spark, monkeypatch):
    """200,000 categories of one feature next to a small one; no label reaches the driver before a name is asked for."""
    rows = spark.range(400_000).select((F.col("id") % 200_000).cast("string").alias("wide"), (F.col("id") % 3).cast("string").alias("small"), F.lit(1.0).alias("x"))
    collected = []
    plain = type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: collected.append(out := plain(df)) or out)
    fitted = M.fit_features(rows, M.FeatureSpec(("x",), ("wide", "small"), True))
    assert max(map(len, collected)) <= 2
    some = fitted.transform(rows.filter("wide in ('0', '5', '199999') and small = '2'"))
    first = some.select("features").first().features
    assert first.size == 1 + 199_999 + 2 and len(first.indices) <= 3
    monkeypatch.undo()
    assert len(fitted.names) == first.size and fitted.names[-1] == "small_2" and fitted.vocabulary["wide"][0] == "0"
    unseen = fitted.transform(spark.createDataFrame([("none", "0", 1.0)], "wide string, small string, x double")).first().features
    assert list(unseen.indices) in ([], [0]) and unseen.size == first.size


def test_rescored_sales_are_those_of_the_primary_study(spark, monkeypatch):
    """The officially qualified rows carry the primary study's predictions, the seasoned ones their own."""
    panel = spark.createDataFrame([(float(i), 0.01 * i) for i in range(20)], "prediction double, years_since_prior_sale double")

    def study(df, development, holdout, **options):
        size = df.count()
        return None, df.select(
            F.lit("holdout_market").alias("sample"), F.lit(True).alias("qualified"), F.lit("2024-01-01").cast("date").alias("sale_date"),
            F.lit(float(size)).alias("prediction"))

    monkeypatch.setattr(M, "valuation_study", study)
    monkeypatch.setattr(M, "valuation_scores", lambda scored: scored.groupBy("sample").agg(F.max("prediction").alias("n")))
    found = {r.rule: r.n for r in M.sensitivity_rerun(panel, "a", "b").collect()}
    assert found["officially_qualified"] == 20.0 and found["seasoned"] < 20.0
