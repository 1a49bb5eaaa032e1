"""Small tables with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from homespell.functions import contracts as C
from homespell.functions import pricing as P
from homespell.functions import scalars as S
from homespell.operators import conformal, linkage, metrics, panels, risk, splits, survival
from homespell.schemas import EPISODES, TRANSACTIONS
from homespell.sources import deeds, sinks


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_operator_names(spark):
    names = {
        "OPENDOOR NORTH 4 LLC": "opendoor", "OPEN DOOR PROPERTY TRUST NINE": "opendoor",
        "OFFERPAD SPVLAKE LLC": "offerpad", "OFFER PAD WEST LLC": "offerpad",
        "OFFERPADINC": "offerpad", "ZILLOW HOMES PINE TRUST": "zillow_offers",
        "REDFINNOW TWO LLC": "redfinnow", "REDFIN NOW THREE LLC": "redfinnow",
        "OPEN DOOR BAKERY": None, "ZILLOW STUDIOS INC": None,
        "MAPLE LEAF BUYERS LLC": None, "OFFER-PAD EAST LLC": None,
    }
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    found = dict(rows(df.select("name", S.classify_operator("name"))))
    assert found == {**names, None: None}


def test_dates_and_numbers(spark):
    df = spark.createDataFrame(
        [("20240315", "$350,000"), ("1704067200000", " 1,2 "), ("2024-03-15T10:00:00", "abc"),
         ("20241399", "NaN"), ("", ""), (None, None)], "d string, n string")
    got = rows(df.select(F.date_format(S.parse_date("d"), "yyyy-MM-dd"), S.parse_number("n")))
    assert got == [("2024-03-15", 350000.0), ("2024-01-01", 12.0), ("2024-03-15", None),
                   (None, None), (None, None), (None, None)]


def test_market_a_row(spark):
    raw = spark.createDataFrame([dict(
        PIN="A-01-29-18", S_DATE="2024-03-15", S_AMT="350,000", QU="Q", VI="I", DOR_CODE="01",
        S_TYPE="WD", NBHC="102001.00", SUB="SUNNY ACRES", GRANTOR="JANE DOE",
        GRANTEE="OPENDOOR NORTH 4 LLC")])
    out = deeds.normalize_market_a(raw)
    assert out.columns == TRANSACTIONS.fieldNames() and len(out.columns) == 23
    row = out.first()
    assert len(row.parcel_id) == 20 and row.parcel_id != "A-01-29-18"
    assert (row.sale_price, row.buyer_operator, row.seller_operator, row.qualified) == (
        350000.0, "opendoor", None, True)
    assert not sinks.unsafe_columns(out.columns)
    with pytest.raises(ValueError):
        sinks.guard_columns(raw)


def test_alias_takes_first_present_even_if_null(spark):
    df = spark.createDataFrame([(None, "x")], "`Sale Date` string, SALEDT string")
    assert rows(S.alias_columns(df, {"d": ("SALE_DATE", "SALE_DT")})) == [(None,)]


def _deeds(spark, data):
    return spark.createDataFrame(
        [(p, m, d, float(v), b, s, i) for i, (p, m, d, v, b, s) in enumerate(data)],
        "parcel_id string, market string, sale_date string, sale_price double, buyer_operator string, "
        "seller_operator string, seq long").withColumn("sale_date", F.to_date("sale_date"))


def test_linkage_cross_operator(spark):
    sales = _deeds(spark, [
        ("a", "m", "2023-01-01", 300000, "opendoor", None),
        ("a", "m", "2023-05-01", 340000, "offerpad", "opendoor"),
        ("a", "m", "2023-08-15", 360000, None, "offerpad"),
        ("b", "m", "2024-02-01", 250000, "opendoor", None)])
    got = rows(linkage.link_episodes(sales, "2024-04-01").select(
        "parcel_id", "operator", "linkage_status", "hold_days", "gross_spread"), "parcel_id", "operator")
    assert got == [("a", "offerpad", "completed", 106, 20000.0),
                   ("a", "opendoor", "completed", 120, 40000.0),
                   ("b", "opendoor", "right_censored", 60, None)]


def test_linkage_repeat_and_horizon(spark):
    sales = _deeds(spark, [
        ("a", "m", "2020-01-01", 300000, "opendoor", None),
        ("a", "m", "2020-03-01", 310000, "opendoor", None),
        ("a", "m", "2020-06-01", 320000, None, "opendoor"),
        ("b", "m", "2019-01-01", 250000, "opendoor", None),
        ("c", "m", "2025-01-01", 250000, "opendoor", None)])
    got = rows(linkage.link_episodes(sales, {"m": "2024-01-01"}, maximum_hold_days=365).select(
        "parcel_id", "linkage_status", "hold_days"), "parcel_id", "hold_days")
    assert got == [("a", "repeat_acquisition_before_exit", 60), ("a", "completed", 92),
                   ("b", "administrative_horizon", 365)]
    with pytest.raises(ValueError):
        linkage.link_episodes(sales, {"other": "2024-01-01"})


def test_repeat_sale_panel(spark):
    sales = _deeds(spark, [
        ("a", "m", "2020-01-15", 100000, None, None), ("b", "m", "2020-02-01", 200000, None, None),
        ("a", "m", "2020-04-15", 120000, None, None)])
    panel = panels.valuation_panel(sales)
    row = panel.filter("prior_sale_price IS NOT NULL").first()
    assert panel.count() == 3
    assert row.years_since_prior_sale == pytest.approx(91 / 365.25)
    assert (row.lagged_market_median_price, row.prior_market_median_price) == (150000.0, 150000.0)
    assert row.log_prior_relative_to_market == pytest.approx(math.log(100 / 150))
    assert row.rolled_forward_prior_baseline == pytest.approx(100000.0)


def test_same_quarter_resale_is_dropped_not_relinked(spark):
    sales = _deeds(spark, [
        ("a", "m", "2020-01-15", 100000, None, None), ("a", "m", "2020-03-20", 110000, None, None),
        ("b", "m", "2020-02-01", 200000, None, None), ("a", "m", "2020-04-15", 120000, None, None)])
    panel = panels.valuation_panel(sales)
    assert panel.filter("sale_date = '2020-03-20'").count() == 0
    row = panel.filter("sale_date = '2020-04-15'").first()
    assert (row.prior_sale_price, row.prior_market_median_price) == (110000.0, 110000.0)


def test_duration_weeks(spark):
    df = spark.createDataFrame([(6, False), (7, False), (0, True), (8, True)], "d int, e boolean")
    assert [r[0] for r in df.select(panels.duration_weeks(F.col("d"), F.col("e"))).collect()] == [0, 1, 1, 2]


def test_admin_censor(spark):
    df = spark.createDataFrame(
        [("2021-12-04", 28, 4, True), ("2021-12-15", 60, 9, False), ("2021-12-01", 60, 8, False),
         ("2021-12-30", 60, 8, False), ("2021-01-01", 30, 5, True)],
        "acquisition_date string, hold_days int, duration_weeks int, event_observed boolean",
    ).withColumn("acquisition_date", F.to_date("acquisition_date"))
    got = rows(survival.admin_censor(df, "2022-01-01").select(
        "hold_days", "duration_weeks", "event_observed", "truncated"), "hold_days")
    assert got == [(17, 2, False, True), (28, 4, False, True), (30, 5, True, False), (31, 4, False, True)]
    with pytest.raises(ValueError):
        survival.admin_censor(df, "2021-01-01")


def test_person_period(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 5, 0), (3, 7, 1)], "u int, d int, e int")
    out = survival.person_period(df, "d", "e", 5)
    assert out.count() == 12
    assert rows(out.groupBy("u").agg(F.sum("event")), "u") == [(1, 1), (2, 0), (3, 0)]


def test_parcel_weighted_error(spark):
    df = spark.createDataFrame(
        [("r", 100.0, 100.0), ("r", 100.0, 100.0), ("r", 100.0, 130.0), ("s", 100.0, 130.0)],
        "parcel_id string, sale_price double, prediction double")
    row = metrics.weighted_valuation_metrics(df, lower=None, upper=None).first()
    assert row.mean_absolute_error == pytest.approx(20.0) and row.n_parcels == 2


def test_scorecard(spark):
    data = [("1", 80.0, True, True, 10, 100.0, 10.0, 1), ("2", 80.0, True, True, 15, 100.0, -5.0, 2),
            ("3", 80.0, True, False, 18, 0.0, -20.0, 3), ("4", 80.0, False, False, 0, 0.0, 0.0, 0)]
    df = spark.createDataFrame(
        [(i, "p", *r[0:]) for i, *r in data],
        "lead_id string, policy_name string, acquisition_offer double, accepted boolean, sold boolean, "
        "weeks_held int, sale_price double, profit double, markdown_count int"
    ).withColumn("capital_deployed", F.lit(None).cast("double"))
    row = metrics.policy_scorecard(df, tail=0.25).first()
    expected = dict(acceptance_rate=.75, sell_through_rate=2 / 3, sell_through_90d=1 / 3,
                    sell_through_120d=2 / 3, mean_profit_per_lead=-3.75, mean_profit_per_accepted_home=-5.0,
                    contribution_margin=-.075, median_weeks_held=15.0, loss_rate=2 / 3,
                    downside_cvar_loss=20.0, p10_profit=-20.0, total_capital_days=80 * 43 * 7,
                    mean_markdowns_per_accepted_home=2.0)
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name


def test_discrete_distribution(spark):
    df = spark.createDataFrame([(1, .05, -100.0), (1, .45, 0.0), (1, .5, 100.0)], "k int, p double, profit double")
    row = risk.tail_statistics(df, ["k"], quantiles={"mid": 0.5}).first()
    assert (row.lower_tail_mean, row.downside_cvar_loss, row.mid) == (
        pytest.approx(-50), pytest.approx(50), 0.0)
    small = risk.compress_distribution(df, ["k"], 2).agg(F.sum("p"), F.sum(F.col("p") * F.col("profit"))).first()
    assert tuple(small) == (pytest.approx(1.0), pytest.approx(45.0))
    assert risk.compress_distribution(df, ["k"], 3).count() == 3


def test_conformal_rank(spark):
    import numpy as np

    for n in (10, 19, 20, 55, 101):
        values = np.random.default_rng(n).random(n)
        level = min(1.0, np.ceil((n + 1) * 0.9) / n)
        df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(values)], "parcel_id string, residual double")
        assert conformal.conformal_radius(df).first().interval_radius == np.quantile(values, level, method="higher")


def test_cents_follow_the_binary_value(spark):
    import random

    draw = random.Random(3)
    prices = [round(draw.uniform(1000, 900000), 2) for _ in range(5000)] + [97.625, 0.125, 2.675]
    df = spark.createDataFrame([(p,) for p in prices], "x double")
    for _, cut in P.ACTIONS:
        got = [r[0] for r in df.select(P.price_after("x", cut)).collect()]
        assert got == [round(p * (1 - cut), 2) for p in prices]


def test_asof(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "2024-01-16", 1), (1, "b", 2.0, "2024-01-08", 2)],
                               "entity_id int, name string, value double, available_at string, seq int"
                               ).withColumn("available_at", F.to_timestamp("available_at"))
    with pytest.raises(ValueError):
        C.values_as_of(df, "2024-01-15")
    assert rows(C.values_as_of(df, "2024-01-15", strict=False)) == [(1, "b", 2.0)]


def test_leaky_features_are_rejected():
    with pytest.raises(ValueError):
        C.guard_features(["sale_quarter", "sale_price"])
    with pytest.raises(ValueError):
        C.guard_features(["truth_value"])
    with pytest.raises(ValueError):
        C.guard_features(["hold_days"], C.EXIT_OUTCOMES)


def test_split_is_disjoint_and_guards(spark):
    df = spark.range(400).select(
        (F.col("id") % 90).cast("string").alias("parcel_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 300).cast("int")).alias("sale_date"))
    cutoffs = splits.date_cutoffs(df, "sale_date")
    labelled = splits.chronological_split(df, "sale_date", cutoffs)
    splits.assert_disjoint(labelled)
    assert splits.split_audit(labelled).agg(F.sum("raw_rows")).first()[0] == 400
    with pytest.raises(ValueError):
        splits.date_cutoffs(df.limit(3), "sale_date")
    assert set(EPISODES.fieldNames()) >= {"hold_days", "linkage_status", "census_block_group"}
