"""Spell linkage in one order of the events: rows as narrow as the order needs, and only keys at a range's end summed up."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from homespell.operators import linkage, scale

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(autouse=True)
def many_ranges(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_following_looks_over_the_ends_of_ranges(spark):
    draw = random.Random(3)
    rows = spark.createDataFrame(
        [("hot" if draw.random() < 0.5 else draw.choice([None, *[f"k{i}" for i in range(30)]]), draw.randrange(300),
          draw.random() if draw.random() < 0.02 else None, i) for i in range(3000)], "k string, v int, w double, seq int")
    groups = scale.order_groups(rows, ["k"], ["v", "seq"])
    assert groups.frame.filter("k = 'hot'").select("_chunk").distinct().count() > 1
    found = groups.following("w", "next").result()
    later = Window.partitionBy("k").orderBy("v", "seq").rowsBetween(1, Window.unboundedFollowing)
    expected = rows.withColumn("next", F.first("w", ignorenulls=True).over(later))
    key = lambda df: sorted(map(repr, df.select("seq", "next").collect()))
    assert key(found) == key(expected)


def test_only_keys_at_the_ends_are_summed_up(spark):
    rows = spark.range(4000).select((F.col("id") % 1000).cast("string").alias("k"), "id")
    groups = scale.order_groups(rows, ["k"], ["id"])
    ranges = groups.frame.select("_chunk").distinct().count()
    assert ranges > 1
    assert groups.edges.count() <= 2 * ranges * 4


def deeds(spark):
    """Random deeds: one hot parcel, null parcels, sales on the day of a purchase, deeds to oneself and copies."""
    draw, parties, rows = random.Random(11), [None, "x", "y"], []
    while len(rows) < 1500:
        row = (draw.choice(["hot", "hot", None, *[f"p{i}" for i in range(40)]]), "m", DAY + datetime.timedelta(draw.randrange(2500)),
               float(draw.choice([20_000, 30_000, 40_000])), draw.choice(parties), draw.choice(parties), len(rows), f"a{len(rows)}")
        rows += [row] + [(*row[:6], len(rows) + 1, "copy")] * (draw.random() < 0.2)
        if row[4] and draw.random() < 0.3:
            rows.append((row[0], "m", row[2], 50_000.0, draw.choice(parties), row[4], len(rows), "same day"))
    return spark.createDataFrame(rows, "parcel_id string, market string, sale_date date, sale_price double, "
                                 "buyer_operator string, seller_operator string, seq int, subdivision string"), rows


def brute(rows, horizon):
    first = {}
    for row in sorted((r for r in rows if r[4] or r[5]), key=lambda r: r[6]):
        first.setdefault(row[:6], row)
    groups, cutoff = {}, max(r[2] for r in first.values())
    for parcel, _, day, price, buyer, seller, seq, kept in first.values():
        if seller:
            groups.setdefault((parcel, seller), []).append((day, price, seq, 0, buyer or "", kept))
        if buyer:
            groups.setdefault((parcel, buyer), []).append((day, price, seq, 1, seller or "", kept))
    out = []
    for (parcel, operator), events in groups.items():
        events.sort()
        for at, (day, price, _, role, _, kept) in enumerate(events):
            if not role:
                continue
            end = next((e for e in events[at + 1:] if e[3] == 1 or e[0] > day), None)
            days = (end[0] - day).days if end else (cutoff - day).days
            if end and end[3] == 0:
                status = "completed" if days <= horizon else "administrative_horizon"
            else:
                status = "repeat_acquisition_before_exit" if end else \
                    "administrative_horizon" if days >= horizon else "right_censored"
            sold = status == "completed"
            out.append((parcel, operator, day, price, end[0] if sold else None, end[1] if sold else None,
                        min(days, horizon) if status != "right_censored" else days, status, kept))
    return sorted(map(repr, out))


def test_spells_equal_a_plain_walk(spark):
    table, rows = deeds(spark)
    found = linkage.link_episodes(table, maximum_hold_days=400).select(
        "parcel_id", "operator", "acquisition_date", "acquisition_price", "resale_date", "resale_price", "hold_days",
        "linkage_status", "subdivision")
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows, 400)


def test_events_are_ordered_without_copies_of_their_columns(spark, monkeypatch):
    table, _ = deeds(spark)
    seen = []

    def watched(events, keys, order):
        seen.append(events)
        return scale.order_groups(events, keys, order)

    monkeypatch.setattr(linkage, "order_groups", watched)
    spells = linkage.link_episodes(table)
    assert len(seen) == 1
    assert set(seen[0].columns) == {*linkage.SPELL_KEY, "sale_date", "sale_price", "seq", "role", "other", "at_start"}
    assert not seen[0].filter("role = 0 AND at_start IS NOT NULL").take(1)
    # The spells come out of the order of events: the only aggregates left are over the keys at the ends of ranges.
    plan = spells._jdf.queryExecution().optimizedPlan().toString()
    main = [line for line in plan.splitlines() if "Aggregate" in line]
    assert all("_chunk" in line for line in main)


def test_copies_of_a_deed_are_told_over_the_ends_of_ranges(spark):
    """A deed with copies in every range, among deeds of its day and price that differ in the seller only, null and empty among them."""
    draw, rows = random.Random(5), []
    for seq in range(2000):
        seller = draw.choice([None, "", "y", "z"])
        rows.append(("hot" if draw.random() < 0.9 else "p", "m", DAY, 20_000.0, "x", seller, seq, f"a{seq}"))
    rows.append(("hot", "m", DAY + datetime.timedelta(9), 30_000.0, None, "x", 2000, "resale"))
    table = spark.createDataFrame(rows, "parcel_id string, market string, sale_date date, sale_price double, "
                                  "buyer_operator string, seller_operator string, seq int, subdivision string")
    found = linkage.link_episodes(table).filter("operator = 'x'").select("parcel_id", "linkage_status", "subdivision").collect()
    first = {}
    for row in rows[:-1]:
        first.setdefault((row[0], row[5]), row)
    last = max((row for row in first.values() if row[0] == "hot"), key=lambda row: row[6])
    status = lambda row: "completed" if row is last else "repeat_acquisition_before_exit"
    hot = sorted((row[0], status(row), row[7]) for row in first.values() if row[0] == "hot")
    assert sorted(tuple(r) for r in found if r.parcel_id == "hot") == hot
    assert len([r for r in found if r.parcel_id == "p"]) == 4


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(at).getName() for at in range(files.size()) if files.apply(at).getName().startswith("shuffle_")}


def test_nothing_is_left_on_disk_of_what_an_order_was_dealt_by(spark):
    spark._jvm.System.gc()
    rows = spark.range(20_000).select((F.col("id") % 100).cast("string").alias("k"), "id")
    before = shuffle_files(spark)
    scale.order_groups(rows.repartition(4, "k"), ["k"], ["id"])
    assert not shuffle_files(spark) - before


def test_stored_sales_are_deleted_once_their_events_are_ordered(spark, tmp_path):
    from pathlib import Path

    from homespell.plans import bindings
    from homespell.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("prepared-*"))
    spells = bindings.episodes(spark, "/root/testdata/sf0.001")
    assert not set(folder.glob("prepared-*")) - before
    assert spells.count()
