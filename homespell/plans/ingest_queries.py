"""Queries for sources, sinks, scalar functions and incremental reading."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from homespell.functions import pricing as P
from homespell.functions import scalars as S
from homespell.operators import linkage, metrics, panels
from homespell.plans import bindings as B
from homespell.plans.query import Registry
from homespell.schemas import TRANSACTIONS
from homespell.session import scratch_path
from homespell.sources import deeds, sinks
from homespell.streaming import incremental

registry = Registry()
query = registry.add

_TX_COLUMNS = (
    "parcel_id s, market s, sale_date d, sale_price f2, qualified b, property_type_code s, "
    "dor_code s, improved b, instrument_type s, year_built f1, living_area_sqft f1, "
    "buyer_operator s, seller_operator s"
)


def _lineitem(spark, sf):
    return B.read(spark, sf, "lineitem")


@query("a1_scan_jsonl", "pin s, amount s, n i",
       f"WITH {B.RAW} SELECT pin, amount, count(*) AS n FROM raw WHERE market = 'market_b' GROUP BY ALL")
def _(spark, sf):
    path = scratch_path(spark, "jsonl")
    source = B.raw_market_b(_lineitem(spark, sf)).select("attributes")
    source.write.option("compression", "gzip").json(path)
    text = T.StructType([T.StructField(n, T.StringType()) for n in ("PARCEL_ID", "SALE_AMOUNT")])
    schema = T.StructType([T.StructField("attributes", text)])
    if deeds.non_object_lines(spark, path).take(1):
        raise ValueError("expected one JSON object per line")
    rows = deeds.scan_jsonl(spark, path, schema).select("attributes.*")
    return rows.groupBy(F.col("PARCEL_ID").alias("pin"), F.col("SALE_AMOUNT").alias("amount")).agg(
        F.count(F.lit(1)).alias("n"))


@query("a2_scan_fixed_width", "PIN s, S_DATE s, S_AMT s, n i",
       f"""WITH {B.RAW} SELECT pin AS "PIN", strftime(shipped, '%Y%m%d') AS "S_DATE",
       amount AS "S_AMT", count(*) AS n FROM raw WHERE deed = 'WD' GROUP BY ALL""")
def _(spark, sf):
    raw = B.raw_deeds(_lineitem(spark, sf))
    lines = raw.select(F.concat(
        F.when(F.col("deed") == "WD", " ").otherwise("*"), F.rpad("pin", 14, " "),
        F.date_format("shipped", "yyyyMMdd"), F.lpad("amount", 16, " "),
    ).alias("value"))
    table = deeds.scan_fixed_width(lines, [("PIN", 14), ("S_DATE", 8), ("S_AMT", 16)])
    return table.groupBy("PIN", "S_DATE", "S_AMT").agg(F.count(F.lit(1)).alias("n"))


@query("a3_scan_csv_typed", _TX_COLUMNS, f"WITH {B.TX} SELECT * FROM tx")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    B.sanitize(_lineitem(spark, sf)).drop("seq").write.option("header", True).csv(path)
    return deeds.scan_csv_typed(spark, path, TRANSACTIONS)


@query("a4_sink_safe_table", "market s, n i, written i",
       f"""WITH {B.TX} SELECT market, count(*) AS n, (SELECT count(*) FROM tx) AS written
       FROM tx GROUP BY market""")
def _(spark, sf):
    path = scratch_path(spark, "safe")
    written = sinks.write_safe_table(B.sanitize(_lineitem(spark, sf)).drop("seq"), path)
    return metrics.group_counts(spark.read.parquet(path), ["market"]).withColumn(
        "written", F.lit(written["rows"]))


#: The table's path as a pattern, which a stream takes for a file as well as for a folder.
_LINEITEM = "{}/lineitem.parque[t]"
#: Files of a trigger at most; the state is carried from one to the next.
_FILES = 64


@query("a5_stream_sanitize", _TX_COLUMNS, f"WITH {B.TX} SELECT * FROM tx")
def _(spark, sf):
    output = scratch_path(spark, "stream-safe")
    source = incremental.file_stream(spark, _LINEITEM.format(sf), _lineitem(spark, sf).schema, "parquet",
                                     files_per_trigger=_FILES)
    incremental.stream_sanitize(source, lambda df: B.sanitize(df).drop("seq"), output,
                                scratch_path(spark, "stream-checkpoint"))
    return spark.read.parquet(output)


@query("a6_union_markets", _TX_COLUMNS, f"WITH {B.TX} SELECT * FROM tx")
def _(spark, sf):
    return B.transactions(spark, sf)


@query("a7_input_provenance", "source s, sha256 s, bytes i, kept_first_time b, blocks i, blocks_sha256 s")
def _(spark, sf):
    known = F.lit("2024-01-01 00:00:00").cast("timestamp")
    prior = deeds.input_provenance(spark, f"{sf}/*.parquet").withColumn("retrieved_at", known)
    again = deeds.input_provenance(spark, f"{sf}/*.parquet", prior)
    blocks = deeds.block_provenance(spark, f"{sf}/*.parquet", 1 << 20)
    return again.withColumn("kept_first_time", F.col("retrieved_at") == known).join(blocks, "path")


@query("a8_prep_manifest", "market s, input_rows i, output_rows i, observation_end d, "
       "party_names_retained s",
       f"""WITH {B.TX} SELECT t.market, count(*) AS input_rows, count(*) AS output_rows,
       max(sale_date) FILTER (sale_price >= 10000) AS observation_end,
       'false' AS party_names_retained FROM tx t GROUP BY 1""")
def _(spark, sf):
    raw = B.raw_deeds(_lineitem(spark, sf))
    prepared = B.transactions(spark, sf)
    return sinks.preparation_manifest(
        prepared.drop("seq"), metrics.group_counts(raw, ["market"], "input_rows"),
        linkage.observation_end(prepared))


@query("a9_export_aggregates", "market s, linkage_status s, n i",
       f"WITH {B.EPISODES} SELECT market, linkage_status, count(*) AS n FROM episodes GROUP BY 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "export")
    counts = metrics.group_counts(B.episodes(spark, sf), ["market", "linkage_status"])
    sinks.export_csv(counts, path, ["market", "linkage_status", "n"], ["market", "linkage_status"])
    return spark.read.option("header", True).csv(path)


@query("a10_source_provenance", "source s, provenance s",
       f"""WITH {B.RAW} SELECT market AS source, to_json({{'publisher': market, 'records': count(*)}})
       AS provenance FROM raw GROUP BY market""")
def _(spark, sf):
    raw = B.raw_deeds(_lineitem(spark, sf))
    records = raw.groupBy(F.col("market").alias("source")).agg(
        F.first("market").alias("publisher"), F.count(F.lit(1)).alias("records"),
        F.lit(None).cast("string").alias("url"), F.max("pin").alias("internal_note"))
    return deeds.source_provenance(records, "source", ["publisher", "url", "records"])


@query("a11_latest_snapshot", "latest s",
       "SELECT 'allsales_' || strftime(max(o_orderdate), '%m_%d_%Y') || '.zip' AS latest FROM orders")
def _(spark, sf):
    names = B.read(spark, sf, "orders").select(
        F.concat(F.lit("allsales_"), F.date_format("o_orderdate", "MM_dd_yyyy"), F.lit(".zip"))
        .alias("path"))
    return deeds.latest_snapshot(names)


# ----------------------------------------------------------------------------- scalar functions

@query("b1_alias_columns", "parcel s, price f2, missing s, n i",
       """SELECT CAST(l_partkey AS VARCHAR) AS parcel, l_extendedprice AS price, NULL AS missing,
       count(*) AS n FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    raw = _lineitem(spark, sf).withColumnsRenamed({"l_partkey": "Parcel-No", "l_extendedprice": "sale amt"})
    found = S.alias_columns(raw, {"parcel": ("PARCEL", "PARCELNO"), "price": ("SALE_AMT", "PRICE"),
                                  "missing": ("NOT_THERE",)})
    return found.groupBy("parcel", "price", "missing").agg(F.count(F.lit(1)).alias("n"))


@query("b2_hash_parcel", "pin s, parcel_id s",
       f"WITH {B.RAW} SELECT DISTINCT pin, {B.hash_sql('market', 'pin')} AS parcel_id FROM raw")
def _(spark, sf):
    return B.raw_deeds(_lineitem(spark, sf)).select(
        "pin", S.hash_parcel("market", "pin").alias("parcel_id")).distinct()


@query("b3_classify_operator", "name s, operator s, n i",
       f"""WITH {B.RAW}, names AS (SELECT grantee AS name FROM raw UNION ALL SELECT grantor FROM raw)
       SELECT name, {B.operator_sql('name')} AS operator, count(*) AS n FROM names GROUP BY ALL""")
def _(spark, sf):
    raw = B.raw_deeds(_lineitem(spark, sf))
    names = raw.select(F.col("grantee").alias("name")).unionAll(raw.select("grantor"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "operator", S.classify_operator("name"))


@query("b4_parse_number", "amount s, price f2, n i",
       f"WITH {B.RAW} SELECT amount, CAST(amt AS DOUBLE) AS price, count(*) AS n FROM raw GROUP BY ALL")
def _(spark, sf):
    raw = B.raw_deeds(_lineitem(spark, sf)).groupBy("amount").agg(F.count(F.lit(1)).alias("n"))
    grouped = F.regexp_replace("amount", r"(\d)(\d{3})$", "$1,$2 ")
    return raw.withColumn("price", S.parse_number(grouped))


@query("b5_parse_date", "shape i, day d, n i",
       f"""WITH {B.RAW} SELECT seq % 4 AS shape, CASE WHEN seq % 4 < 3 THEN CAST(shipped AS DATE) END
       AS day, count(*) AS n FROM raw GROUP BY ALL""")
def _(spark, sf):
    shape = F.col("seq") % 4
    text = (
        F.when(shape == 0, F.date_format("shipped", "yyyyMMdd"))
        .when(shape == 1, F.unix_millis("shipped").cast("string"))
        .when(shape == 2, F.date_format("shipped", "yyyy-MM-dd'T'12:34:56"))
        .otherwise("not a date")
    )
    return B.raw_deeds(_lineitem(spark, sf)).groupBy(
        shape.alias("shape"), S.parse_date(text).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _flag_query(name, function, words, true_words, false_words):
    listed = ", ".join(f"'{w}'" for w in words)
    yes = ", ".join(f"'{w}'" for w in true_words)
    no = ", ".join(f"'{w}'" for w in false_words)
    sql = (
        f"WITH words AS (SELECT [{listed}][CAST(l_orderkey % {len(words)} + 1 AS INTEGER)] AS word "
        f"FROM lineitem) SELECT word, CASE WHEN upper(trim(word)) IN ({yes}) THEN TRUE "
        f"WHEN upper(trim(word)) IN ({no}) THEN FALSE END AS flag, count(*) AS n FROM words GROUP BY ALL"
    )

    @query(name, "word s, flag b, n i", sql)
    def _(spark, sf):
        array = F.array(*[F.lit(w) for w in words])
        word = F.element_at(array, (F.col("l_orderkey") % len(words)).cast("int") + 1)
        counts = _lineitem(spark, sf).groupBy(word.alias("word")).agg(F.count(F.lit(1)).alias("n"))
        return counts.withColumn("flag", function("word"))


_WORDS = ("Q", "qualified", " Y ", "yes", "TRUE", "1", "A", "Arms Length", "U", "unqualified", "N",
          "no", "False", "0", "I", "Improved", "V", "vacant", "T", "F", "maybe", "")
_flag_query("b6_parse_qualified", S.parse_qualified, _WORDS, S.QUALIFIED_TRUE, S.QUALIFIED_FALSE)
_flag_query("b8_parse_improved", S.parse_improved, _WORDS, S.IMPROVED_TRUE, S.IMPROVED_FALSE)
_flag_query("b9_parse_boolean", S.parse_boolean, _WORDS, S.BOOLEAN_TRUE, S.BOOLEAN_FALSE)
_flag_query("b11_bool_vocab", S.nullable_flag, _WORDS, [w.upper() for w in S.FLAG_TRUE],
            [w.upper() for w in S.FLAG_FALSE])


@query("b7_qualified_from_description", "text s, flag b, n i",
       """WITH d AS (SELECT CASE l_returnflag WHEN 'A' THEN ' Sale Qualified by Appraiser'
       WHEN 'R' THEN 'DEED CHANGE ONLY' ELSE '  ' END AS text FROM lineitem)
       SELECT text, CASE WHEN trim(text) = '' THEN NULL ELSE upper(trim(text)) LIKE 'SALE QUALIFIED%'
       END AS flag, count(*) AS n FROM d GROUP BY ALL""")
def _(spark, sf):
    text = (F.when(F.col("l_returnflag") == "A", " Sale Qualified by Appraiser")
            .when(F.col("l_returnflag") == "R", "DEED CHANGE ONLY").otherwise("  "))
    return _lineitem(spark, sf).groupBy(text.alias("text")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("flag", S.qualified_from_description("text"))


@query("b10_safe_text", "text s, n i",
       """SELECT nullif(trim(CASE WHEN length(text) % 2 = 0 THEN '  ' || lang || ' ' ELSE ' ' END), '')
       AS text, count(*) AS n FROM documents GROUP BY 1""")
def _(spark, sf):
    padded = F.when(F.length("text") % 2 == 0, F.concat(F.lit("  "), "lang", F.lit(" "))).otherwise(" ")
    return B.read(spark, sf, "documents").groupBy(S.safe_text(padded).alias("text")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b12_normalize_market_a", _TX_COLUMNS + ", neighborhood s",
       f"WITH {B.TX} SELECT * FROM tx WHERE market = 'market_a'")
def _(spark, sf):
    return deeds.normalize_market_a(B.raw_market_a(_lineitem(spark, sf)), B.MARKET_A)


@query("b13_normalize_market_b", _TX_COLUMNS + ", effective_year_built f1",
       f"WITH {B.TX} SELECT * FROM tx WHERE market = 'market_b'")
def _(spark, sf):
    return deeds.normalize_market_b(B.raw_market_b(_lineitem(spark, sf)), B.MARKET_B)


def _audit_sql(name: str, source: str, texts: str, named: str = "") -> str:
    """The privacy audit of one table: ``texts`` are looked into, columns in ``named`` must be empty."""
    def among(words):
        return "list_has_any(w, [" + ", ".join(f"'{word}'" for word in words) + "])"

    words = "list_filter(string_split_regex(upper({}), '[^A-Z0-9]+'), lambda t: t <> '')"
    judge = f"coalesce(list_transform([{words}], lambda w: {among(sinks.PARTY_WORDS)} OR (coalesce(regexp_matches(w[1], '^[0-9]{{{{1,6}}}}$'), FALSE) AND {among(sinks.STREET_WORDS)}))[1], FALSE)"
    flags = [judge.format(column) for column in texts.split()] + [f"{column} IS NOT NULL" for column in named.split()]
    some = " + ".join(f"max(f[{at + 1}]::INT)" for at in range(len(flags)))
    return (f"SELECT '{name}' AS table_name, coalesce({some}, 0) AS unsafe, count(*) FILTER (NOT list_contains(f, TRUE)) AS passed_rows, "
            f"count(*) FILTER (list_contains(f, TRUE)) AS refused_rows FROM (SELECT [{', '.join(flags)}] AS f FROM {source})")


_RAW_TEXTS = "market pin amount l_returnflag vi dor deed kind"
_SAFE_TEXTS = "parcel_id market property_type_code dor_code instrument_type neighborhood buyer_operator seller_operator"


@query("b14_pii_guard", "table_name s, unsafe i, passed_rows i, refused_rows i",
       f"WITH {B.TX} {_audit_sql('prepared', 'tx', _SAFE_TEXTS)} UNION ALL {_audit_sql('raw', 'raw', _RAW_TEXTS, 'grantee grantor')} "
       f"UNION ALL {_audit_sql('renamed', 'raw', _RAW_TEXTS + ' grantee grantor')}")
def _(spark, sf):
    """What the guard finds in the values of the prepared table, the raw one, and the raw one under harmless names."""
    raw = B.raw_deeds(_lineitem(spark, sf))
    tables = {"prepared": B.transactions(spark, sf), "raw": raw, "renamed": raw.withColumnsRenamed({"grantor": "first_side", "grantee": "second_side"})}
    parts = [sinks.privacy_audit(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b15_calendar_features", "o_orderkey i, sale_year i, sale_quarter i, elapsed f9, log_price f9",
       """SELECT o_orderkey, year(o_orderdate) AS sale_year, quarter(o_orderdate) AS sale_quarter,
       date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) / 365.25 AS elapsed,
       ln(o_totalprice) AS log_price FROM orders""")
def _(spark, sf):
    orders = panels.calendar_features(B.read(spark, sf, "orders"), "o_orderdate", "sale")
    start = F.lit("1990-01-01").cast("date")
    return orders.withColumns({"elapsed": S.elapsed_years(start, "o_orderdate"),
                               "log_price": S.positive_log("o_totalprice")})


@query("b16_property_age", "age f1, n i",
       f"""WITH {B.TX} SELECT year(sale_date) - coalesce(CASE WHEN effective_year_built BETWEEN 1800
       AND year(sale_date) THEN effective_year_built END, year_built) AS age, count(*) AS n
       FROM tx GROUP BY 1""")
def _(spark, sf):
    age = S.property_age(F.year("sale_date"), F.col("effective_year_built"), F.col("year_built"))
    return B.transactions(spark, sf).groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("b17_area_features", "living_area_sqft f1, log_living_area f9, lowest_price_per_sqft f9, highest_price_per_sqft f9, n i",
       f"""WITH {B.TX} SELECT living_area_sqft, CASE WHEN living_area_sqft > 0
       THEN ln(living_area_sqft) END AS log_living_area,
       min(CASE WHEN living_area_sqft > 0 THEN sale_price / living_area_sqft END) AS lowest_price_per_sqft,
       max(CASE WHEN living_area_sqft > 0 THEN sale_price / living_area_sqft END) AS highest_price_per_sqft,
       count(*) AS n FROM tx GROUP BY ALL""")
def _(spark, sf):
    sales = B.transactions(spark, sf).withColumn("sale_year", F.year("sale_date"))
    featured = panels.structure_features(sales, "sale_year", "sale_price")
    return featured.groupBy("living_area_sqft", "log_living_area").agg(
        F.min("nominal_price_per_sqft").alias("lowest_price_per_sqft"),
        F.max("nominal_price_per_sqft").alias("highest_price_per_sqft"), F.count(F.lit(1)).alias("n"))


@query("b18_repeat_sale_features", "parcel_id s, sale_date d, sale_price f2, prior_sale_price f2, "
       "log_prior_relative_to_market f9, rolled_forward_prior_baseline f4",
       f"WITH {B.PANEL} SELECT * FROM panel WHERE prior_sale_price IS NOT NULL")
def _(spark, sf):
    return B.panel(spark, sf).filter(F.col("prior_sale_price").isNotNull())


_CENTS_SQL = """CAST(round(CAST({p} AS DECIMAL(38, 20)) * CAST({m} AS DECIMAL(18, 6)), 2) AS DOUBLE)"""


@query("b19_price_action", "action s, ord i, n i, total_price f0",
       """WITH x AS (SELECT o_totalprice * (CAST(1 AS DOUBLE) - cut) AS x, action, ord FROM orders,
        (VALUES ('hold', 0, CAST(0.0 AS DOUBLE)), ('cut_1_pct', 1, CAST(0.01 AS DOUBLE)),
        ('cut_2_5_pct', 2, CAST(0.025 AS DOUBLE)), ('cut_5_pct', 3, CAST(0.05 AS DOUBLE))) a(action, ord, cut)),
       h AS (SELECT *, floor(x * 100) AS low, (floor(x * 100) + 0.5::DOUBLE) / 100::DOUBLE AS half FROM x),
       s AS (SELECT *, half * 134217729::DOUBLE - (half * 134217729::DOUBLE - half) AS hi FROM h),
       r AS (SELECT *, (hi * 200 - (low * 2 + 1)) + (half - hi) * 200 AS off FROM s)
       SELECT action, ord, count(*) AS n, sum(CAST(low + CASE WHEN x > half THEN 1 WHEN x < half THEN 0
        WHEN off > 0 THEN 1 WHEN off < 0 THEN 0 ELSE low % 2 END AS BIGINT)) AS total_price
       FROM r GROUP BY ALL""")
def _(spark, sf):
    actions = F.array(*[
        F.struct(F.lit(a).alias("action"), F.lit(o).alias("ord"), F.lit(c).alias("cut"))
        for a, o, c in P.action_table()
    ])
    rows = B.read(spark, sf, "orders").select("o_totalprice", F.inline(actions))
    return rows.groupBy("action", "ord").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(P.cents(F.col("o_totalprice") * (1.0 - F.col("cut")))).alias("total_price"))


@query("b20_contribution_profit", "o_orderkey i, profit f6",
       """SELECT o_orderkey, o_totalprice - o_totalprice * 0.9::DOUBLE - 100 - 50
       - (25 + 0.06::DOUBLE * o_totalprice) - (2 + o_orderkey % 17 + 1) * 12.5::DOUBLE AS profit FROM orders""")
def _(spark, sf):
    price = F.col("o_totalprice")
    return B.read(spark, sf, "orders").select("o_orderkey", P.contribution_profit(
        price, price * 0.9, F.lit(100), F.lit(50), F.lit(25), F.lit(0.06), F.lit(2),
        F.col("o_orderkey") % 17, F.lit(12.5)).alias("profit"))


@query("b21_sigmoid_logit", "o_orderkey i, probability f9, log_odds f6, clipped f6",
       """WITH p AS (SELECT o_orderkey, 1 / (1 + exp(-(o_totalprice / 50000 - 5))) AS probability FROM orders)
       SELECT o_orderkey, probability,
       ln(greatest(least(probability, 1 - 1e-8), 1e-8) / (1 - greatest(least(probability, 1 - 1e-8), 1e-8))) AS log_odds,
       ln(1e-9::DOUBLE / (1 - 1e-9::DOUBLE)) AS clipped FROM p""")
def _(spark, sf):
    p = P.sigmoid(F.col("o_totalprice") / 50_000 - 5)
    return B.read(spark, sf, "orders").select(
        "o_orderkey", p.alias("probability"), P.logit(p).alias("log_odds"),
        P.logit(0.0, 1e-9).alias("clipped"))


_SCENARIOS = (P.Scenario("soft", 0.2, 0.97, 0.8), P.Scenario("base", 0.6, 1.0, 1.0),
              P.Scenario("strong", 0.2, 1.03, 1.2))


@query("b22_elasticity_scenarios", "property_id i, name s, sale_probability f9, sale_price f4",
       f"""WITH {B.LEADS}, sc(name, p, vm, dm) AS (VALUES ('soft', 0.2::DOUBLE, 0.97::DOUBLE, 0.8::DOUBLE),
       ('base', 0.6::DOUBLE, 1::DOUBLE, 1::DOUBLE), ('strong', 0.2::DOUBLE, 1.03::DOUBLE, 1.2::DOUBLE))
       SELECT property_id, name, 1 / (1 + exp(-(ln(0.22::DOUBLE / (1 - 0.22::DOUBLE))
        - 8 * (value * 1.025::DOUBLE / (value * vm) - 1) + 0.02::DOUBLE * 3 + ln(dm) + 0.35::DOUBLE)))
        AS sale_probability,
       least(value * 1.025::DOUBLE * (1 - 0.005::DOUBLE), value * vm) AS sale_price FROM leads, sc""")
def _(spark, sf):
    value = F.col("value")
    scenarios = P.elasticity_scenarios(
        value, value * 1.025, F.lit(3), base_probability=0.22, elasticity=8.0, dom_per_week=0.02,
        shift=0.35, scenarios=_SCENARIOS)
    return B.leads(spark, sf).select("property_id", F.inline(scenarios))


@query("b23_logistic_acceptance", "property_id i, acceptance f9",
       f"""WITH {B.LEADS} SELECT property_id, 1 / (1 + exp(-(0.1::DOUBLE + property_id % 5 * 0.05::DOUBLE
       + 26 * (value * 0.9::DOUBLE / value - 0.9::DOUBLE)))) AS acceptance FROM leads""")
def _(spark, sf):
    return B.leads(spark, sf).select("property_id", P.logistic_acceptance(
        F.col("value") * 0.9, F.col("value"), midpoint=0.9, slope=26.0, intercept=0.1,
        urgency=F.col("property_id") % 5 * 0.05).alias("acceptance"))


@query("b24_fixed_spread_offer", "property_id i, offer f2",
       f"WITH {B.LEADS} SELECT property_id, value * 92 / 100 AS offer FROM leads")
def _(spark, sf):
    return B.leads(spark, sf).select("property_id", P.fixed_spread_offer("value", 0.08).alias("offer"))


@query("b25_scheduled_markdown", "week i, action s, n i",
       """SELECT o_orderkey % 17 AS week, CASE WHEN o_orderkey % 17 >= 2 AND (o_orderkey % 17 - 2) % 3 = 0
       THEN 'cut_2_5_pct' ELSE 'hold' END AS action, count(*) AS n FROM orders GROUP BY ALL""")
def _(spark, sf):
    week = F.col("o_orderkey") % 17
    return B.read(spark, sf, "orders").groupBy(
        week.alias("week"), P.scheduled_action(week, "cut_2_5_pct", 3, 2).alias("action")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("b26_release_rounding", "o_orderkey i, ratio f6, broken f6",
       """SELECT o_orderkey, round(o_totalprice / 7, 6) AS ratio, CASE WHEN o_orderkey % 3 > 0
       THEN round(o_totalprice / 3, 6) END AS broken FROM orders""")
def _(spark, sf):
    broken = F.when(F.col("o_orderkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 3)
    return S.round_release(B.read(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 7).alias("ratio"), broken.alias("broken")))


@query("b27_serialize_dates", "day s, n i",
       "SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    days = B.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    return S.serialize_dates(days.agg(F.count(F.lit(1)).alias("n")))


@query("b28_gross_spread", "parcel_id s, operator s, acquisition_date d, acquisition_price f2, "
       "gross_spread f2, gross_return f9",
       f"WITH {B.EPISODES} SELECT * FROM episodes")
def _(spark, sf):
    return panels.gross_spread(B.episodes(spark, sf).drop("gross_spread", "gross_return"))


_STRESS = (("soft", 0.35), ("base", 0.5), ("rebound", 0.15))


@query("b29_proceeds_stress", "property_id i, name s, probability f6, proceeds f4",
       f"""WITH {B.LEADS}, v AS (SELECT property_id, value, value * 0.92::DOUBLE AS lo,
       value * 1.07::DOUBLE AS hi FROM leads)
       SELECT property_id, 'soft' AS name, 0.35 AS probability,
        least(value * 1.075::DOUBLE * 0.995::DOUBLE, lo) AS proceeds FROM v
       UNION ALL SELECT property_id, 'base', 0.5, least(value * 1.075::DOUBLE * 0.995::DOUBLE, value) FROM v
       UNION ALL SELECT property_id, 'rebound', 0.15, least(value * 1.075::DOUBLE * 0.995::DOUBLE, hi) FROM v""")
def _(spark, sf):
    value = F.col("value")
    scenarios = P.stress_scenarios(value * 0.92, value, value * 1.07, _STRESS)
    return B.leads(spark, sf).select("property_id", "value", F.inline(scenarios)).withColumn(
        "proceeds", P.stressed_proceeds(F.col("value") * 1.075, F.col("resale_value")))


@query("b30_as_utc", "event_id i, instant s",
       """SELECT event_id, strftime(CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END,
       '%Y-%m-%d %H:%M:%S') AS instant FROM events""")
def _(spark, sf):
    zone = F.when(F.col("event_id") % 2 == 0, "+02:00")
    instant = S.as_utc("ts", zone)
    return B.read(spark, sf, "events").select(
        "event_id", F.date_format(instant, "yyyy-MM-dd HH:mm:ss").alias("instant"))


# ------------------------------------------------------------------------------------ streaming

def _stream(spark, sf):
    schema = _lineitem(spark, sf).schema
    return B.sanitize(incremental.file_stream(spark, _LINEITEM.format(sf), schema, "parquet",
                                              files_per_trigger=_FILES))


@query("l1_stream_observation_end", "market s, observation_end d",
       f"""WITH {B.TX} SELECT market, max(sale_date) AS observation_end FROM tx
       WHERE sale_price >= 10000 GROUP BY market""")
def _(spark, sf):
    return incremental.drain(spark, incremental.observation_end_stream(_stream(spark, sf)),
                             "market", "update")


@query("l2_stream_source_counts", "market s, source_rows i, base_rows i, selected_rows i",
       f"""WITH {B.TX}, {B.FLAGS} SELECT market, count(*) AS source_rows,
       count(*) FILTER (is_base) AS base_rows,
       count(*) FILTER (is_base AND (is_official OR is_proxy)) AS selected_rows FROM flags GROUP BY 1""")
def _(spark, sf):
    flagged = panels.universe_flags(_stream(spark, sf), B.CUTOFF, B.MARKET_B)
    return incremental.drain(spark, incremental.source_count_stream(flagged), "market", "complete")
