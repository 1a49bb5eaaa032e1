"""Ranges carried forward must give what plain windows and plain Python give, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from homespell.operators import conformal, linkage, metrics, panels, risk, scale, survival


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(5)
    data = [("hot" if draw.random() < 0.6 else f"k{draw.randrange(40)}", draw.randrange(400),
             round(draw.uniform(1, 50), 2), i) for i in range(3000)]
    return spark.createDataFrame(data, "k string, v int, w double, seq int")


def frozen(df):
    names = sorted(df.columns)
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r)
                  for r in df.select(*names).collect())


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables would otherwise be coalesced into one range."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_values(skewed, keys):
    groups = scale.order_groups(skewed, keys, ["v", "seq"])
    assert groups.frame.select("_chunk").distinct().count() > 1
    found = groups.previous("w", "before").running_sum("w", "upto").totals("w", "total").result()
    order = Window.partitionBy(*keys).orderBy("v", "seq")
    expected = (skewed.withColumn("before", F.lag("w").over(order))
                .withColumn("upto", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("total", F.sum("w").over(Window.partitionBy(*keys))))
    assert frozen(found) == frozen(expected)


@pytest.mark.parametrize("keys", [["k"], []])
def test_folds_of_one_pass(skewed, keys):
    """All folds together, by one aggregate over the ranges and one broadcast join."""
    rows = skewed.withColumns({"f": 1 + F.col("w") / 1e4, "h": F.xxhash64("seq")})
    found = scale.order_groups(rows, keys, ["v", "seq"]).carry(
        onward=scale.Carried("w", over="onward"), before=scale.Carried("h", "xor", "before"),
        grown=scale.Carried("f", "product"), every=scale.Carried("h", "xor", "all"), last=scale.Carried("w", "last", "upto"))
    plan = found.frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") == 1
    order = Window.partitionBy(*keys).orderBy("v", "seq")
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    expected = rows.withColumns({
        "onward": F.sum("w").over(order.rowsBetween(0, end)), "before": F.bit_xor("h").over(order.rowsBetween(start, -1)),
        "grown": F.product("f").over(order.rowsBetween(start, 0)), "every": F.bit_xor("h").over(order.rowsBetween(start, end)),
        "last": F.col("w")})
    assert frozen(found.result()) == frozen(expected)


def test_survival_of_one_key_with_a_million_durations(spark):
    spells = spark.range(1_000_000).select(F.lit("one").alias("k"), F.col("id").alias("hold_days"), (F.col("id") % 2 == 0).alias("event_observed"))
    table = survival.km_table(spells, ["k"])
    widest = table.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert widest < 600_000
    row = table.filter("duration = 500000").first()
    assert row.at_risk == 500_000
    # Steps at even days d leave (1 - 1 / (n - d)); their product telescopes up to the odd days.
    import numpy as np
    days = np.arange(0, 500_001, 2)
    assert row.survival == pytest.approx(float(np.exp(np.log1p(-1 / (1_000_000 - days)).sum())), rel=1e-9)


def test_percentiles_and_ranks(skewed):
    found = scale.exact_percentiles(skewed, ["k"], "w", {"m": 0.5, "p9": 0.9})
    expected = skewed.groupBy("k").agg(F.percentile("w", F.lit(0.5)).alias("m"), F.percentile("w", F.lit(0.9)).alias("p9"))
    assert frozen(found) == frozen(expected)
    placed = {(r.v, r.seq): r.position for r in scale.rank_positions(skewed, ["v", "seq"], "position").collect()}
    assert [placed[k] for k in sorted(placed)] == list(range(len(placed)))
    assert conformal.even_sample(skewed, 50, ["v", "seq"]).count() == 50


def test_weighted_quantiles_and_tails(skewed):
    rows = {}
    for r in skewed.collect():
        rows.setdefault(r.k, []).append((r.v, r.w))
    for r in scale.weighted_quantiles(skewed, ["k"], "v", "w", {"m": 0.5}).collect():
        total, upto = sum(w for _, w in rows[r.k]), 0.0
        for v, w in sorted(rows[r.k]):
            upto += w
            if upto / total + scale.MASS_TOLERANCE >= 0.5:
                break
        assert r.m == v
    tails = risk.tail_statistics(skewed.select("k", F.col("w").alias("p"), (F.col("v") - 200.0).alias("profit")), ["k"])
    for r in tails.collect():
        total, left, loss = sum(w for _, w in rows[r.k]), 0.1, 0.0
        for v, w in sorted(rows[r.k]):
            mass = min(w / total, left)
            left, loss = left - mass, loss + mass * max(200.0 - v, 0.0)
        assert r.downside_cvar_loss == pytest.approx(loss / 0.1)


def test_compression_keeps_the_mean(skewed):
    atoms = skewed.select("k", "seq", F.col("w").alias("p"), (F.col("v") - 200.0).alias("profit"))
    folded = risk.compress_distribution(atoms, ["k"], 7, ["seq"])
    assert folded.groupBy("k").count().agg(F.max("count")).first()[0] == 7
    mean = lambda df: {r.k: r.expected_profit for r in risk.expected_profit(df, ["k"]).collect()}
    assert mean(folded) == pytest.approx(mean(atoms))


def test_auc_of_scores_in_a_narrow_band(spark):
    draw = random.Random(9)
    rows = [(0.01 + draw.randrange(40) * 1e-7, int(draw.random() < 0.3)) for _ in range(500)]
    found = metrics.roc_auc(spark.createDataFrame(rows, "hazard double, event int")).first()[0]
    positives, negatives = ([s for s, y in rows if y == k] for k in (1, 0))
    wins = sum((p > n) + (p == n) / 2 for p in positives for n in negatives)
    assert found == pytest.approx(wins / len(positives) / len(negatives))


def test_row_is_attached_by_one_subquery(spark):
    one = spark.range(5).agg(F.sum("id").alias("a"), F.max("id").alias("b"), F.min("id").alias("c"))
    attached = scale.attach_row(spark.range(3), one)
    assert attached.columns == ["id", "a", "b", "c"] and attached.first()[1:] == (10, 4, 0)
    assert attached._jdf.queryExecution().executedPlan().toString().count("Subquery subquery#") <= 2


def _walk(deeds, operators, cutoff, maximum):
    """Plain state machine over one parcel at a time, written from the rules."""
    spells, parcels = [], {}
    for parcel, day, price, buyer, seller, seq in deeds:
        parcels.setdefault(parcel, []).append((day, price, seq, buyer, seller))
    for parcel, sales in parcels.items():
        for operator in operators:
            start = None
            for day, price, _, buyer, seller in sorted(sales, key=lambda s: s[:3]):
                if seller == operator and start is not None and day > start:
                    held = day - start
                    spells.append((parcel, operator, start, min(held, maximum),
                                   "completed" if held <= maximum else "administrative_horizon"))
                    start = None
                if buyer == operator:
                    if start is not None:
                        spells.append((parcel, operator, start, min(day - start, maximum),
                                       "repeat_acquisition_before_exit"))
                    start = day
            if start is not None:
                open_days = cutoff - start
                spells.append((parcel, operator, start, min(open_days, maximum),
                               "administrative_horizon" if open_days >= maximum else "right_censored"))
    return sorted(spells)


def test_linkage_matches_state_machine(spark):
    draw = random.Random(11)
    operators = ["opendoor", "offerpad", None]
    deeds, seen = [], set()
    for i in range(900):
        parcel = "hot" if draw.random() < 0.4 else f"p{draw.randrange(60)}"
        row = (parcel, draw.randrange(900), float(20000 + draw.randrange(5) * 1000),
               draw.choice(operators), draw.choice(operators))
        if row not in seen and (row[3] or row[4]):
            seen.add(row)
            deeds.append((*row, i))
    df = spark.createDataFrame(deeds, "parcel_id string, d int, sale_price double, buyer_operator string, "
                               "seller_operator string, seq long").select(
        "parcel_id", F.lit("m").alias("market"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("sale_date"),
        "sale_price", "buyer_operator", "seller_operator", "seq")
    out = linkage.link_episodes(df, "2022-07-01", maximum_hold_days=120)
    start = F.datediff("acquisition_date", F.lit("2020-01-01").cast("date"))
    got = sorted(tuple(r) for r in out.select("parcel_id", "operator", start, "hold_days", "linkage_status").collect())
    assert got == _walk(deeds, operators[:2], 912, 120)


def test_dedupe_with_prior_sale_agree(spark):
    draw = random.Random(2)
    df = spark.createDataFrame(
        [("m", "hot" if draw.random() < .5 else f"p{draw.randrange(9)}", draw.randrange(60),
          float(draw.randrange(3)), i) for i in range(600)],
        "market string, parcel_id string, d int, sale_price double, seq int",
    ).withColumn("sale_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    copies = Window.partitionBy("market", "parcel_id", "sale_date", "sale_price").orderBy(F.col("seq").desc())
    unique = df.withColumn("n", F.row_number().over(copies)).filter("n = 1").drop("n")
    before = Window.partitionBy("market", "parcel_id").orderBy("sale_date", "seq", "sale_price")
    expected = unique.withColumns({"prior_sale_date": F.lag("sale_date").over(before), "prior_sale_price": F.lag("sale_price").over(before)})
    assert frozen(panels.dedupe_with_prior_sale(df)) == frozen(expected)
