"""The forest's traits and cut come from all labelled rows, however few its trees draw from."""

import numpy as np
from pyspark.sql import functions as F

from homespell.llm import quality_rules


def _tables(spark):
    statistics = spark.range(600).select(
        F.col("id").alias("doc_id"), F.col("id").alias("row_key"), (40 + F.col("id") * 37 % 101).alias("n_words"), (200 + F.col("id") * 53 % 301).alias("word_chars"),
        F.when(F.col("id") % 10 == 0, 20 + F.col("id") % 7).otherwise(F.col("id") % 3).cast("long").alias("n_symbols"),
        F.lit(0).cast("long").alias("n_dup_lines"), (F.col("id") % 5).alias("n_repeat_words"))
    return statistics, spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"))


def test_cut_over_a_table_is_the_cut_over_its_rows(spark):
    statistics, labels = _tables(spark)
    forest, cut = quality_rules.fit(statistics, labels)
    rows = statistics.join(labels, "doc_id").orderBy(F.xxhash64("doc_id")).toPandas()
    traits, good = quality_rules._traits(rows[list(quality_rules.STATISTICS)].to_numpy()), (rows.quality == 1).to_numpy()
    expected, expected_cut = quality_rules.calibrate(traits, good)
    assert forest.traits == expected.traits and cut == expected_cut and np.array_equal(forest.cut, expected.cut)


def test_rows_that_no_tree_draws_from_count_for_the_cut(spark):
    statistics, labels = _tables(spark)
    forest, cut = quality_rules.fit(statistics, labels, sample_rows=60)
    rows = statistics.join(labels, "doc_id").toPandas()
    score, good = forest.score(quality_rules._traits(rows[list(quality_rules.STATISTICS)].to_numpy())), (rows.quality == 1).to_numpy()
    assert cut == quality_rules.calibrated_cut(score[good], score[~good])
    assert quality_rules.fit(statistics, labels.withColumn("quality", F.lit(0))) == (None, np.inf)
