"""Views that give the driver tables the shape of deeds, spells, leads and distributions.

Each view exists twice: as a DataFrame built with the library, and as SQL text for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homespell import session
from homespell.operators import linkage, panels
from homespell.sources import deeds, sinks

MARKET_A, MARKET_B = "market_a", "market_b"
CUTOFF = "1996-01-01"

# Invented party names: one or two for each operator rule, and some that only look like an operator's.
PARTIES = (
    "OPENDOOR NORTH 4 LLC", "OPEN DOOR PROPERTY TRUST NINE", "OFFERPAD LAKE HOLDINGS LLC",
    "OFFER PAD WEST LLC", "OFFERPADINC", "ZILLOW HOMES PINE TRUST", "REDFINNOW TWO LLC",
    "REDFIN NOW THREE LLC", "OPEN DOOR BAKERY", "ZILLOW STUDIOS INC",
    "MAPLE LEAF BUYERS LLC", None,
)
_PARTY_SQL = "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in PARTIES) + "]"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _party(key: str):
    names = F.array(*[F.lit(p) for p in PARTIES])
    return F.element_at(names, (F.col(key) % len(PARTIES)).cast("int") + 1)


def raw_deeds(lineitem: DataFrame) -> DataFrame:
    """Line items as untidy deed rows; every tenth order is delivered twice."""
    copies = F.when(F.col("l_orderkey") % 10 == 0, 2).otherwise(1)
    built = 1940 + F.col("l_suppkey") % 70
    return lineitem.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies))
    ).select(
        F.when(F.col("l_partkey") % 3 == 0, MARKET_B).otherwise(MARKET_A).alias("market"),
        F.col("l_partkey").cast("string").alias("pin"),
        F.col("l_shipdate").cast("timestamp").alias("shipped"),
        F.concat(F.lit("$"), F.floor(F.col("l_extendedprice") * 10).cast("string")).alias("amount"),
        "l_returnflag",
        F.when((F.col("l_linestatus") == "F") | (F.col("l_linenumber") % 2 == 0), "I")
        .otherwise("V").alias("vi"),
        F.when(F.col("l_partkey") % 5 == 0, "0400").otherwise("0100").alias("dor"),
        F.when(F.col("l_linenumber") % 3 == 0, "QC").otherwise("WD").alias("deed"),
        F.when(F.col("l_suppkey") % 7 == 0, "Single Family").otherwise("0400").alias("kind"),
        _party("l_suppkey").alias("grantee"),
        _party("l_orderkey").alias("grantor"),
        built.alias("built"),
        (built + F.col("l_linenumber") * 4).alias("effective"),
        (F.col("l_partkey") * 7 % 160 * 100 + F.col("l_linenumber") * 10).alias("area"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 2 + F.col("copy") - 1).alias("seq"),
    )


def raw_market_a(lineitem: DataFrame) -> DataFrame:
    return raw_deeds(lineitem).filter(F.col("market") == MARKET_A).select(
        F.col("pin").alias("PIN"), F.date_format("shipped", "yyyyMMdd").alias("S_DATE"),
        F.col("amount").alias("S_AMT"),
        F.when(F.col("l_returnflag") == "A", "Q").when(F.col("l_returnflag") == "R", "U").alias("QU"),
        F.col("vi").alias("VI"), F.col("dor").alias("DOR_CODE"), F.col("deed").alias("S_TYPE"),
        F.concat(F.lit(" N"), F.col("built").cast("string"), F.lit(" ")).alias("NBHC"),
        F.col("grantor").alias("GRANTOR"), F.col("grantee").alias("GRANTEE"), "seq",
    )


def raw_market_b(lineitem: DataFrame) -> DataFrame:
    attributes = F.struct(
        F.col("pin").alias("PARCEL_ID"),
        F.unix_millis("shipped").alias("SALE_DATE"),
        F.col("amount").alias("SALE_AMOUNT"),
        F.when(F.col("l_returnflag") == "A", "Sale Qualified by Property Appraiser")
        .when(F.col("l_returnflag") == "R", "MULTI-PARCEL SALE").otherwise(" ")
        .alias("SALE_DESCRIPTION"),
        F.col("kind").alias("SALE_TYPE"), F.col("dor").alias("DOR_CODE"),
        F.col("vi").alias("VAC_IMPR_CODE"), F.col("deed").alias("DEED_CODE"),
        F.col("built").alias("AYB"), F.col("effective").alias("EYB"),
        F.col("area").alias("LIVING_AREA"),
        F.col("grantor").alias("GRANTOR"), F.col("grantee").alias("GRANTEE"),
    )
    return raw_deeds(lineitem).filter(F.col("market") == MARKET_B).select(
        attributes.alias("attributes"), "seq"
    )


def sanitize(lineitem: DataFrame) -> DataFrame:
    return deeds.union_markets(
        deeds.normalize_market_a(raw_market_a(lineitem), MARKET_A, keep=["seq"]),
        deeds.normalize_market_b(raw_market_b(lineitem), MARKET_B, keep=["seq"]),
    )


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The sanitized sales, parsed where they are read; only the columns a query uses are parsed."""
    return sanitize(deeds.spread(read(spark, sf, "lineitem")))


def stored_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a written table, for plans that read it several times."""
    return sinks.prepare_table(transactions(spark, sf))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat-sale panel of the analysis universe."""
    universe = panels.analysis_universe(stored_transactions(spark, sf), CUTOFF, MARKET_B)
    return panels.valuation_panel(universe, require_qualified=False)


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    sales = stored_transactions(spark, sf)
    spells = linkage.link_episodes(sales, None)
    # The events that spells are read off are a table of their own.
    session.discard(sales)
    return spells


def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a written table, for studies that read it many times."""
    return sinks.prepare_table(panel(spark, sf), "panel")


def episode_table(spark: SparkSession, sf: str) -> DataFrame:
    """Linked spells as a written table, for studies that read them many times."""
    return sinks.prepare_table(episodes(spark, sf), "episodes")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as survival units."""
    hold = (F.col("o_orderkey") * 37 % 400).cast("int")
    event = F.col("o_orderstatus") == "F"
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("unit"), F.col("o_orderpriority").alias("grp"),
        hold.alias("hold_days"), event.alias("event_observed"),
        panels.duration_weeks(hold, event).alias("duration_weeks"),
        F.to_date("o_orderdate").alias("acquisition_date"),
        F.col("o_custkey").cast("string").alias("parcel_id"),
        F.col("o_totalprice").alias("acquisition_price"),
    )


def backtest(spark: SparkSession, sf: str) -> DataFrame:
    accepted, sold = F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"
    weeks = (F.col("o_orderkey") % 25).cast("int")
    offer = F.col("o_totalprice")
    sale = F.when(sold, offer * (0.9 + F.col("o_orderkey") % 30 / 100)).otherwise(0.0)
    profit = F.when(sold, sale - offer - 200 * weeks).when(accepted, -200.0 * weeks).otherwise(0.0)
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("lead_id"),
        F.col("o_orderpriority").alias("policy_name"), offer.alias("acquisition_offer"),
        accepted.alias("accepted"), sold.alias("sold"), weeks.alias("weeks_held"),
        sale.alias("sale_price"), profit.alias("profit"),
        (F.col("o_orderkey") % 4).cast("int").alias("markdown_count"),
        F.lit(None).cast("double").alias("capital_deployed"),
    )


def distributions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("dist_id"), F.col("value").alias("p"),
        (F.col("value") * 10 - 500).alias("profit"), "event_id",
    )


def as_of_features(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("name"), "value",
        F.col("ts").cast("timestamp").alias("available_at"), F.col("event_id").alias("seq"),
    )


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("grp"),
        (F.col("o_orderkey") % 7 + 1).cast("int").alias("period"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        ((F.col("o_orderkey") % 97 + 1) / 99).alias("p"),
        F.col("o_custkey").alias("episode"), (F.col("o_custkey") % 50).alias("parcel"),
    )


def leads(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    value = (150_000 + key % 1000 * 900).cast("double")
    return deeds.spread(read(spark, sf, "customer")).select(
        key.alias("property_id"), value.alias("value"), (value * 0.03).alias("repair_cost"),
        (value * 0.0015).alias("weekly_holding_cost"), (key % 4 * 0.3).alias("risk_aversion"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )


# ---------------------------------------------------------------------------------------------
# The same views as SQL. Each entry is one common table expression.

_OPERATOR_SQL = """CASE
 WHEN {x} IS NULL THEN NULL
 WHEN NOT regexp_matches(upper({x}), 'OPENDOOR|OPEN DOOR|OFFERPAD|OFFER PAD|ZILLOW HOME|REDFIN')
  THEN NULL
 WHEN regexp_matches({c}, '^OPENDOOR(\\s|$)') THEN 'opendoor'
 WHEN regexp_matches({c}, '^OPEN DOOR PROPERTY TRUST(\\s|$)') THEN 'opendoor'
 WHEN regexp_matches({c}, '^OFFER ?PAD(\\s|LLC|INC|SOLUTIONS|SPV|$)') THEN 'offerpad'
 WHEN regexp_matches({c}, '^ZILLOW HOMES?(\\s|$)') THEN 'zillow_offers'
 WHEN regexp_matches({c}, '^REDFIN\\s*NOW(\\s|$)') THEN 'redfinnow' END"""


def operator_sql(column: str) -> str:
    cleaned = f"trim(regexp_replace(upper({column}), '[^A-Z0-9]+', ' ', 'g'))"
    return _OPERATOR_SQL.format(x=column, c=cleaned)


def hash_sql(market: str, pin: str) -> str:
    return (
        "substr(sha256('homespell-parcel-v1:' || "
        f"upper(trim({market} || ':' || upper(trim({pin}))))), 1, 20)"
    )


RAW = f"""raw AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN 'market_b' ELSE 'market_a' END AS market,
 CAST(l_partkey AS VARCHAR) AS pin, l_shipdate AS shipped,
 CAST(floor(l_extendedprice * 10) AS BIGINT) AS amt,
 '$' || CAST(CAST(floor(l_extendedprice * 10) AS BIGINT) AS VARCHAR) AS amount, l_returnflag,
 CASE WHEN l_linestatus = 'F' OR l_linenumber % 2 = 0 THEN 'I' ELSE 'V' END AS vi,
 CASE WHEN l_partkey % 5 = 0 THEN '0400' ELSE '0100' END AS dor,
 CASE WHEN l_linenumber % 3 = 0 THEN 'QC' ELSE 'WD' END AS deed,
 CASE WHEN l_suppkey % 7 = 0 THEN 'Single Family' ELSE '0400' END AS kind,
 {_PARTY_SQL}[CAST(l_suppkey % 12 + 1 AS INTEGER)] AS grantee,
 {_PARTY_SQL}[CAST(l_orderkey % 12 + 1 AS INTEGER)] AS grantor,
 1940 + l_suppkey % 70 AS built, 1940 + l_suppkey % 70 + l_linenumber * 4 AS effective,
 l_partkey * 7 % 160 * 100 + l_linenumber * 10 AS area,
 (l_orderkey * 10 + l_linenumber) * 2 + copy - 1 AS seq
 FROM lineitem, LATERAL (SELECT unnest(CASE WHEN l_orderkey % 10 = 0 THEN [1, 2] ELSE [1] END) AS copy))"""

TX = RAW + f""",
tx AS (SELECT {hash_sql('market', 'pin')} AS parcel_id, market, CAST(shipped AS DATE) AS sale_date,
 CAST(amt AS DOUBLE) AS sale_price,
 CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'R' THEN FALSE END AS qualified,
 CASE WHEN market = 'market_b' THEN kind ELSE dor END AS property_type_code, dor AS dor_code,
 vi = 'I' AS improved, deed AS instrument_type,
 CASE WHEN market = 'market_b' THEN CAST(built AS DOUBLE) END AS year_built,
 CASE WHEN market = 'market_b' THEN CAST(effective AS DOUBLE) END AS effective_year_built,
 CASE WHEN market = 'market_b' THEN CAST(area AS DOUBLE) END AS living_area_sqft,
 CASE WHEN market = 'market_a' THEN 'N' || built END AS neighborhood,
 {operator_sql('grantee')} AS buyer_operator, {operator_sql('grantor')} AS seller_operator, seq
 FROM raw)"""

FLAGS = f"""flags AS (SELECT *,
 coalesce(sale_date >= DATE '{CUTOFF}' AND sale_price BETWEEN 25000 AND 10000000 AND improved
  AND (dor_code LIKE '01%' OR lower(property_type_code) LIKE '%single family%'), FALSE) AS is_base,
 coalesce(qualified, FALSE) AS is_official,
 market = 'market_b' AND qualified IS NULL AND instrument_type = 'WD' AS is_proxy FROM tx)"""

UNIVERSE = TX + ",\n" + FLAGS + """,
universe AS (SELECT * FROM flags WHERE is_base AND (is_official OR is_proxy))"""

PANEL = UNIVERSE + """,
eligible AS (SELECT * FROM universe WHERE living_area_sqft IS NULL
 OR living_area_sqft BETWEEN 300 AND 15000),
sales AS (SELECT * FROM eligible QUALIFY row_number() OVER (
 PARTITION BY market, parcel_id, sale_date, sale_price ORDER BY seq DESC) = 1),
linked AS (SELECT *, lag(sale_date) OVER w AS prior_sale_date, lag(sale_price) OVER w AS prior_sale_price,
 year(sale_date) * 4 + quarter(sale_date) - 1 AS sale_q
 FROM sales WINDOW w AS (PARTITION BY market, parcel_id ORDER BY sale_date, seq, sale_price)),
linked_q AS (SELECT *, year(prior_sale_date) * 4 + quarter(prior_sale_date) - 1 AS prior_q FROM linked),
med AS (SELECT market, sale_q AS q, median(sale_price) AS market_quarter_median FROM linked GROUP BY 1, 2),
medlag AS (SELECT *, lag(market_quarter_median) OVER (PARTITION BY market ORDER BY q)
 AS lagged_market_median_price FROM med),
panel AS (SELECT l.*, a.lagged_market_median_price, b.market_quarter_median AS prior_market_median_price,
 date_diff('day', prior_sale_date, sale_date) / 365.25 AS years_since_prior_sale,
 ln(prior_sale_price) - ln(b.market_quarter_median) AS log_prior_relative_to_market,
 prior_sale_price * a.lagged_market_median_price / b.market_quarter_median
  AS rolled_forward_prior_baseline
 FROM linked_q l LEFT JOIN medlag a ON l.market = a.market AND l.sale_q = a.q
 LEFT JOIN medlag b ON l.market = b.market AND l.prior_q = b.q
 WHERE l.prior_q IS NULL OR l.prior_q < l.sale_q)"""

REPEAT = PANEL + """,
repeats AS (SELECT *, year(sale_date) AS sale_year, quarter(sale_date) AS sale_quarter
 FROM panel WHERE prior_sale_price > 0
 AND prior_market_median_price > 0 AND lagged_market_median_price > 0
 AND rolled_forward_prior_baseline > 0 AND years_since_prior_sale BETWEEN 0 AND 4.5)"""

EPISODES = TX + """,
opdeeds AS (SELECT * FROM tx WHERE sale_date IS NOT NULL AND sale_price >= 10000
 AND (buyer_operator IS NOT NULL OR seller_operator IS NOT NULL)),
cuts AS (SELECT market, max(sale_date) AS cutoff FROM opdeeds GROUP BY 1),
deeds AS (SELECT o.*, c.cutoff FROM opdeeds o JOIN cuts c USING (market)
 WHERE o.sale_date <= c.cutoff QUALIFY row_number() OVER (PARTITION BY parcel_id, market, sale_date,
 sale_price, buyer_operator, seller_operator ORDER BY seq) = 1),
ev AS (SELECT market, parcel_id, seller_operator AS operator, 0 AS role,
  coalesce(buyer_operator, '') AS other, sale_date, sale_price, seq, cutoff, improved, dor_code,
  property_type_code FROM deeds WHERE seller_operator IS NOT NULL
 UNION ALL SELECT market, parcel_id, buyer_operator, 1, coalesce(seller_operator, ''), sale_date,
  sale_price, seq, cutoff, improved, dor_code, property_type_code
  FROM deeds WHERE buyer_operator IS NOT NULL),
seqd AS (SELECT *, row_number() OVER w AS rn, sum(role) OVER (w ROWS UNBOUNDED PRECEDING) AS gid
 FROM ev WINDOW w AS (PARTITION BY market, parcel_id, operator
 ORDER BY sale_date, sale_price, seq, role, other)),
acq AS (SELECT *, lead(sale_date) OVER (PARTITION BY market, parcel_id, operator ORDER BY rn)
 AS next_acq FROM seqd WHERE role = 1),
ex AS (SELECT a.market, a.parcel_id, a.operator, a.gid, min(e.rn) AS rn FROM acq a JOIN seqd e
 ON e.market = a.market AND e.parcel_id = a.parcel_id AND e.operator = a.operator AND e.gid = a.gid
 AND e.role = 0 AND e.sale_date > a.sale_date GROUP BY 1, 2, 3, 4),
joined AS (SELECT a.*, e.sale_date AS exit_date, e.sale_price AS exit_price,
 date_diff('day', a.sale_date, e.sale_date) AS exit_days FROM acq a
 LEFT JOIN ex x ON x.market = a.market AND x.parcel_id = a.parcel_id AND x.operator = a.operator
  AND x.gid = a.gid
 LEFT JOIN seqd e ON e.market = x.market AND e.parcel_id = x.parcel_id AND e.operator = x.operator
  AND e.rn = x.rn),
judged AS (SELECT *, CASE WHEN exit_days <= 1095 THEN 'completed'
 WHEN exit_days IS NOT NULL THEN 'administrative_horizon'
 WHEN next_acq IS NOT NULL THEN 'repeat_acquisition_before_exit'
 WHEN date_diff('day', sale_date, cutoff) >= 1095 THEN 'administrative_horizon'
 ELSE 'right_censored' END AS linkage_status FROM joined),
episodes AS (SELECT parcel_id, market, operator, sale_date AS acquisition_date,
 sale_price AS acquisition_price, linkage_status, linkage_status = 'completed' AS event_observed,
 CASE WHEN linkage_status = 'completed' THEN exit_date END AS resale_date,
 CASE WHEN linkage_status = 'completed' THEN exit_price END AS resale_price,
 CASE linkage_status WHEN 'completed' THEN exit_days WHEN 'administrative_horizon' THEN 1095
  WHEN 'repeat_acquisition_before_exit' THEN least(date_diff('day', sale_date, next_acq), 1095)
  ELSE date_diff('day', sale_date, cutoff) END AS hold_days,
 CASE WHEN linkage_status = 'completed' THEN exit_price - sale_price END AS gross_spread,
 CASE WHEN linkage_status = 'completed' THEN (exit_price - sale_price) / sale_price END AS gross_return,
 improved, dor_code, property_type_code FROM judged)"""

EPISODE_PANEL = EPISODES + """,
epanel AS (SELECT * FROM (SELECT *, CAST(CASE WHEN event_observed
  THEN greatest(1, ceil(hold_days / 7)) ELSE floor(hold_days / 7) END AS BIGINT) AS duration_weeks
 FROM episodes WHERE linkage_status IN ('completed', 'right_censored', 'administrative_horizon')
 AND acquisition_price BETWEEN 10000 AND 20000000 AND hold_days BETWEEN 0 AND 3650
 AND (NOT event_observed OR (resale_date >= acquisition_date AND resale_price > 0)))
 WHERE event_observed OR duration_weeks >= 1)"""

UNITS = """units AS (SELECT o_orderkey AS unit, o_orderpriority AS grp, o_orderkey * 37 % 400 AS hold_days,
 o_orderstatus = 'F' AS event_observed, CAST(CASE WHEN o_orderstatus = 'F'
  THEN greatest(1, ceil((o_orderkey * 37 % 400) / 7)) ELSE floor((o_orderkey * 37 % 400) / 7) END AS BIGINT)
  AS duration_weeks, CAST(o_orderdate AS DATE) AS acquisition_date,
 CAST(o_custkey AS VARCHAR) AS parcel_id, o_totalprice AS acquisition_price FROM orders)"""

BACKTEST = """base AS (SELECT *, o_orderstatus <> 'P' AS accepted, o_orderstatus = 'F' AS sold,
 o_orderkey % 25 AS weeks_held FROM orders),
bt0 AS (SELECT CAST(o_orderkey AS VARCHAR) AS lead_id, o_orderpriority AS policy_name,
 o_totalprice AS acquisition_offer, accepted, sold, weeks_held,
 CASE WHEN sold THEN o_totalprice * (CAST(0.9 AS DOUBLE) + o_orderkey % 30 / CAST(100 AS DOUBLE))
  ELSE 0 END AS sale_price, o_orderkey % 4 AS markdown_count FROM base),
bt AS (SELECT *, CASE WHEN sold THEN sale_price - acquisition_offer - 200 * weeks_held
 WHEN accepted THEN -200.0 * weeks_held ELSE 0 END::DOUBLE AS profit FROM bt0)"""

DISTRIBUTIONS = """dist0 AS (SELECT user_id AS dist_id, value AS p, value * 10 - 500 AS profit, event_id
 FROM events WHERE value > 0),
dist AS (SELECT dist_id, event_id, profit, p / sum(p) OVER (PARTITION BY dist_id) AS p FROM dist0),
cum AS (SELECT *, sum(p) OVER (PARTITION BY dist_id ORDER BY profit, event_id
 ROWS UNBOUNDED PRECEDING) AS upto FROM dist)"""

FEATURES = """feats AS (SELECT user_id AS entity_id, event_type AS name, value, ts AS available_at,
 event_id AS seq FROM events)"""

PROBS = """probs AS (SELECT o_orderpriority AS grp, CAST(o_orderkey % 7 + 1 AS INTEGER) AS period,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y,
 (o_orderkey % 97 + 1) / CAST(99 AS DOUBLE) AS p, o_custkey AS episode, o_custkey % 50 AS parcel FROM orders)"""

LEADS = """leads0 AS (SELECT c_custkey AS property_id,
 CAST(150000 + c_custkey % 1000 * 900 AS DOUBLE) AS value, c_custkey % 4 AS k,
 c_mktsegment AS segment, c_acctbal AS balance FROM customer),
leads AS (SELECT property_id, value, value * CAST(0.03 AS DOUBLE) AS repair_cost,
 value * CAST(0.0015 AS DOUBLE) AS weekly_holding_cost, k * CAST(0.3 AS DOUBLE) AS risk_aversion,
 segment, balance FROM leads0)"""
