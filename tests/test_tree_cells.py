"""Boosted trees are grown on cells of binned features and equal those of all rows."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from homespell.operators import models as M


def _sales(spark, n=3000):
    r = random.Random(7)
    rows = [(f"p{k % 400}", r.gauss(0, 1), None if k % 50 == 0 else r.randint(0, 400) / 365, k % 4 + 1, r.random()) for k in range(n)]
    df = spark.createDataFrame(rows, "parcel_id string, a double, b double, q int, noise double")
    return df.withColumn("price", F.exp(F.sin("a") + F.coalesce("b", F.lit(0.0)) * F.col("q") / 4 + F.col("noise") / 5))


def test_cells_give_the_trees_of_all_rows(spark, monkeypatch):
    sales, spec = _sales(spark), M.FeatureSpec(("a", "b", "q"))
    fitted = []
    fit = GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, df, *more: (fitted.append(df.count()), fit(self, df, *more))[1])
    held = F.crc32(F.col("parcel_id").cast("binary")) % 5 == 0
    model = M.fit_gbt_conformal(sales.filter(~held), sales.filter(held), "price", spec, max_iter=12)
    assert fitted[0] <= 32 * 32 * 4 and fitted[0] < sales.filter(~held).count()
    middle = model.features.medians["b"]
    plain = VectorAssembler(inputCols=["a", "b", "q"], outputCol="features").transform(sales.fillna({"b": middle}).withColumn("_label", F.ln("price")))
    monkeypatch.undo()
    rows = GBTRegressor(labelCol="_label", maxIter=12, stepSize=0.06, maxDepth=5, seed=0).fit(plain.filter(~held)).transform(plain)
    expected = {(r.parcel_id, r.noise): r.prediction for r in rows.collect()}
    got = {(r.parcel_id, r.noise): r.prediction for r in model.transform(sales).withColumn("prediction", F.ln("prediction")).collect()}
    assert got == pytest.approx(expected, abs=1e-9)


def test_cells_count_grows_with_bins_not_rows(spark):
    few = spark.range(20_000).select((F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    edges = M.bin_edges(few, ["x", "y"])
    assert edges["x"] == tuple(k + 0.5 for k in range(6)) and len(edges["y"]) == 31
    fitted = M.Features(M.FeatureSpec(("x", "y")), {"x": 0.0, "y": 0.0}, {"x": (0.0, 1.0), "y": (0.0, 1.0)}, {}, {}, edges=edges)
    cells = fitted.cells(few, F.col("y"))
    assert cells.count() == 7 * 32 and cells.agg(F.sum("_many")).first()[0] == 20_000
    assert cells.groupBy("_n_y").agg(F.sum("_many").alias("n")).agg(F.max("n") - F.min("n")).first()[0] <= 2


def test_edges_with_a_value_of_most_copies(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 800, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    edges = M.bin_edges(rows, ["x"])["x"]
    assert list(edges) == sorted(set(edges)) and 5.0 < edges[0] < 802 and len(edges) <= 31
    assert M.bin_edges(rows.limit(0), ["x"]) == {"x": ()}
