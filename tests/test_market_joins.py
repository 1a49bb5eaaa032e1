"""Tables of a row per market, quarter or operator are joined where the rows lie; tables are written without a sort."""

from homespell.operators import linkage, panels, splits
from homespell.sources import sinks


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffled(plan):
    """Lines of joins that move both their sides."""
    return [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]


def test_no_row_moves_to_the_task_of_its_market(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sales = spark.sql("SELECT 'a' AS market, 'p' || id % 7 AS parcel_id, date_add(DATE '2000-01-01', cast(id AS int)) AS sale_date, 20000.0D + id AS sale_price, "
                          "CASE WHEN id > 6 THEN date_add(DATE '2000-01-01', cast(id - 7 AS int)) END AS prior_sale_date, 'x' AS operator FROM range(400)")
        cut = linkage.market_cutoff_join(sales, None)
        ends = linkage.observation_end(sales, spark.sql("SELECT 'a' AS market, DATE '2000-03-01' AS latest"))
        kept = splits.keep_supported(sales, spark.sql("SELECT 'x' AS operator"))
        medians = spark.sql("SELECT 'a' AS market, 8000 AS q, 1.0D AS market_quarter_median, 2.0D AS lagged_market_median_price")
        priced = panels.join_quarter_medians(sales, medians)
        for df in (cut, ends, kept, priced):
            assert not _shuffled(_plan(df)), _plan(df)
        assert (cut.count(), kept.count(), priced.count(), ends.first()["observation_end"].isoformat()) == (400, 400, 400, "2000-03-01")
        assert priced.filter("lagged_market_median_price = 2").count() == 91 and priced.filter("prior_market_median_price = 1").count() == 91
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_are_written_unsorted_and_whole(spark, tmp_path):
    rows = spark.sql("SELECT 'm' || id % 40 AS market, id FROM range(0, 4000, 1, 2)")
    seen = []
    conf = spark.conf
    original = type(conf).set
    try:
        type(conf).set = lambda self, name, value: (seen.append((name, value)), original(self, name, value))[1]
        counted = sinks.write_safe_table(rows, str(tmp_path / "t"))
    finally:
        type(conf).set = original
    assert counted == {"rows": 4000} and [value for name, value in seen if "Concurrent" in name] == [str(sinks.OPEN_FILES), "0"]
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 4000 and back.select("id").distinct().count() == 4000 and back.select("market").distinct().count() == 40
