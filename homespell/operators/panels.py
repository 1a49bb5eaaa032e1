"""Screens, repeat-sale valuation panel and validated episode panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from homespell.functions import scalars as S
from homespell.operators.scale import exact_percentiles, order_groups

SALE_KEY = ("market", "parcel_id", "sale_date", "sale_price")
MINIMUM_PRICE, MAXIMUM_PRICE = 25_000.0, 10_000_000.0
SEASONED_YEARS = 30 / 365.25
EPISODE_STATUSES = ("completed", "right_censored", "administrative_horizon")


def valuation_screen(df: DataFrame, *, minimum_price=MINIMUM_PRICE, maximum_price=MAXIMUM_PRICE,
                     minimum_area=300.0, maximum_area=15_000.0, require_qualified=True,
                     require_improved=True) -> DataFrame:
    """Sales with a key, a date, a price in range and an area that is plausible or unknown."""
    if not 0 < minimum_price < maximum_price or not 0 < minimum_area < maximum_area:
        raise ValueError("bounds must be positive and ordered")
    kept = (
        F.col("parcel_id").isNotNull() & F.col("market").isNotNull()
        & F.col("sale_date").isNotNull()
        & F.col("sale_price").between(minimum_price, maximum_price)
    )
    if "living_area_sqft" in df.columns:
        area = F.col("living_area_sqft")
        kept &= area.isNull() | area.between(minimum_area, maximum_area)
    for flag, wanted in (("qualified", require_qualified), ("improved", require_improved)):
        if wanted and flag in df.columns:
            kept &= S.strict_flag(df, flag)
    return df.filter(kept).withColumn("market", F.lower(S.strip("market")))


def single_family(df: DataFrame) -> Column:
    dor = F.coalesce(F.col("dor_code").startswith("01"), F.lit(False))
    kind = F.coalesce(F.lower("property_type_code").contains("single family"), F.lit(False))
    return dor | kind


def universe_flags(df: DataFrame, cutoff: str, proxy_market: str = "market_b") -> DataFrame:
    """Adds the three conditions of the analysis universe: base, official and deed proxy."""
    qualified = S.nullable_flag("qualified")
    base = (
        (F.col("sale_date") >= F.lit(cutoff).cast("date"))
        & F.col("sale_price").between(MINIMUM_PRICE, MAXIMUM_PRICE)
        & F.coalesce(S.nullable_flag("improved"), F.lit(False))
        & single_family(df)
    )
    proxy = (
        (F.col("market") == proxy_market) & qualified.isNull()
        & (F.upper(S.strip("instrument_type")) == "WD")
    )
    return df.withColumns({
        "is_base": F.coalesce(base, F.lit(False)),
        "is_official": F.coalesce(qualified, F.lit(False)),
        "is_proxy": F.coalesce(proxy, F.lit(False)),
    })


def analysis_universe(df: DataFrame, cutoff: str, proxy_market: str = "market_b") -> DataFrame:
    return (
        universe_flags(df, cutoff, proxy_market)
        .filter(F.col("is_base") & (F.col("is_official") | F.col("is_proxy")))
        .drop("is_base", "is_official", "is_proxy")
        .withColumn("property_type_code", F.lit("single_family"))
    )


def selection_audit(df: DataFrame, cutoff: str, markets: Sequence[str],
                    proxy_market: str = "market_b") -> DataFrame:
    """Sample funnel per studied market, in one pass."""
    flags = universe_flags(df.filter(F.col("market").isin(*markets)), cutoff, proxy_market)
    base, official, proxy = F.col("is_base"), F.col("is_official"), F.col("is_proxy")
    return flags.groupBy("market").agg(
        F.count_if(base).alias("date_price_improved_single_family"),
        F.count_if(base & official).alias("officially_qualified"),
        F.count_if(base & proxy).alias("warranty_deed_proxy"),
        F.count_if(base & (official | proxy)).alias("selected"),
    )


def dedupe_keep_last(df: DataFrame, seq: str = "seq", key: Sequence[str] = SALE_KEY) -> DataFrame:
    """One row per key, the last ingested; copies combine before the shuffle."""
    rest = [name for name in df.columns if name not in key]
    last = F.max_by(F.struct(*rest), F.struct(seq)).alias("_last")
    return df.groupBy(*key).agg(last).select(*key, "_last.*").select(*df.columns)


def with_prior_sale(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Date and price of the previous eligible sale of the same parcel."""
    marked = df.withColumn("_sale", F.struct("sale_date", "sale_price"))
    ordered = order_groups(marked, ("market", "parcel_id"), ("sale_date", seq, "sale_price"))
    return ordered.previous("_sale", "_prior").result().withColumns({
        "prior_sale_date": F.col("_prior.sale_date"),
        "prior_sale_price": F.col("_prior.sale_price"),
    }).drop("_sale", "_prior")


def dedupe_with_prior_sale(df: DataFrame, seq: str = "seq") -> DataFrame:
    return with_prior_sale(dedupe_keep_last(df, seq), seq)


def quarterly_medians(df: DataFrame) -> DataFrame:
    """Exact median price per market and quarter, and the one of the previous observed quarter."""
    sales = df.select("market", S.calendar_quarter("sale_date").alias("q"), "sale_price")
    medians = exact_percentiles(sales, ("market", "q"), "sale_price", {"market_quarter_median": 0.5})
    # One row per quarter and market: the window is as long as the calendar.
    window = Window.partitionBy("market").orderBy("q")
    return medians.withColumn(
        "lagged_market_median_price", F.lag("market_quarter_median").over(window)
    )


def join_quarter_medians(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Attach the lagged median of the sale quarter and the median of the prior sale's quarter."""
    current = medians.select("market", F.col("q").alias("sale_q"), "lagged_market_median_price")
    prior = medians.select(
        "market", F.col("q").alias("prior_q"),
        F.col("market_quarter_median").alias("prior_market_median_price"),
    )
    keyed = df.withColumns({
        "sale_q": S.calendar_quarter("sale_date"),
        "prior_q": S.calendar_quarter("prior_sale_date"),
    })
    # One row per market and quarter: joined where the sales lie, since sales of a market crowd in few quarters, and first sales
    # have no prior quarter.
    return keyed.join(F.broadcast(current), ["market", "sale_q"], "left").join(
        F.broadcast(prior), ["market", "prior_q"], "left"
    )


def repeat_sale_features(df: DataFrame) -> DataFrame:
    prior, lagged = F.col("prior_sale_price"), F.col("lagged_market_median_price")
    prior_median = F.col("prior_market_median_price")
    return df.withColumns({
        "years_since_prior_sale": S.elapsed_years("prior_sale_date", "sale_date"),
        "log_prior_sale_price": F.ln(prior),
        "log_lagged_market_median": F.ln(lagged),
        "log_prior_relative_to_market": F.ln(prior) - F.ln(prior_median),
        "rolled_forward_prior_baseline": prior * lagged / prior_median,
    })


def strict_prior_quarter(df: DataFrame) -> DataFrame:
    """Drop a sale whose previous sale lies in its own quarter; never link to an older one."""
    return df.filter(F.col("prior_q").isNull() | (F.col("prior_q") < F.col("sale_q")))


def structure_features(df: DataFrame, year: str, price: str | None = None) -> DataFrame:
    """Age and area features, each only when its source column exists."""
    added = {}
    if "year_built" in df.columns:
        effective = (
            F.col("effective_year_built") if "effective_year_built" in df.columns
            else F.lit(None).cast("double")
        )
        added["property_age_years"] = S.property_age(F.col(year), effective, F.col("year_built"))
    if "living_area_sqft" in df.columns:
        area = F.when(F.col("living_area_sqft") > 0, F.col("living_area_sqft"))
        added["log_living_area"] = F.ln(area)
        if price:
            added["nominal_price_per_sqft"] = F.col(price) / area
    return df.withColumns(added) if added else df


def calendar_features(df: DataFrame, date: str, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_year": F.year(date), f"{prefix}_quarter": F.quarter(date)})


def valuation_panel(transactions: DataFrame, *, seq: str = "seq", **screen) -> DataFrame:
    """Screened sales with prior sale, lagged market medians and structure features."""
    eligible = valuation_screen(transactions, **screen)
    linked = dedupe_with_prior_sale(eligible, seq)
    medians = quarterly_medians(eligible.select(*SALE_KEY).distinct())
    panel = strict_prior_quarter(repeat_sale_features(join_quarter_medians(linked, medians)))
    return structure_features(
        calendar_features(panel, "sale_date", "sale"), "sale_year", "sale_price"
    )


def repeat_sale_window(panel: DataFrame, maximum_years: float = 4.5,
                       minimum_years: float = 0.0) -> DataFrame:
    return panel.filter(
        (F.col("prior_sale_price") > 0) & (F.col("prior_market_median_price") > 0)
        & (F.col("lagged_market_median_price") > 0)
        & (F.col("rolled_forward_prior_baseline") > 0)
        & F.col("years_since_prior_sale").between(minimum_years, maximum_years)
    )


def duration_weeks(hold_days: Column, event: Column) -> Column:
    """Observed exits count started weeks, at least one; censored spells count full weeks."""
    observed = F.greatest(F.lit(1), F.ceil(hold_days / 7))
    return F.when(event, observed).otherwise(F.floor(hold_days / 7)).cast("int")


def gross_spread(df: DataFrame) -> DataFrame:
    """Spread and return of observed exits; null for every censored spell."""
    spread = F.col("resale_price") - F.col("acquisition_price")
    seen = F.col("event_observed")
    return df.withColumns({
        "gross_spread": F.when(seen, spread),
        "gross_return": F.when(seen, spread / F.col("acquisition_price")),
    })


def episode_validity(df: DataFrame, statuses: Sequence[str] = EPISODE_STATUSES) -> DataFrame:
    """Valid spells with ``duration_weeks``; ``event_observed`` becomes a strict boolean."""
    seen = S.strict_flag(df, "event_observed")
    valid = (
        F.col("parcel_id").isNotNull() & F.col("market").isNotNull()
        & F.col("operator").isNotNull() & F.col("acquisition_date").isNotNull()
        & F.col("acquisition_price").between(10_000, 20_000_000)
        & F.col("hold_days").between(0, 3_650)
    )
    if "linkage_status" in df.columns:
        valid &= F.lower(S.strip("linkage_status")).isin(*statuses)
    if "resale_date" in df.columns:
        ordered = F.col("resale_date") >= F.col("acquisition_date")
        valid &= ~seen | F.coalesce(ordered, F.lit(False))
    if "resale_price" in df.columns:
        valid &= ~seen | F.coalesce(F.col("resale_price") > 0, F.lit(False))
    weeks = duration_weeks(F.col("hold_days"), F.col("event_observed"))
    return (
        df.filter(valid)
        .withColumns({
            "event_observed": seen,
            "market": F.lower(S.strip("market")),
            "operator": S.strip("operator"),
        })
        .withColumn("duration_weeks", weeks)
        .filter(F.col("event_observed") | (F.col("duration_weeks") >= 1))
    )


def episode_panel(df: DataFrame, statuses: Sequence[str] = EPISODE_STATUSES) -> DataFrame:
    """Validated spells with decision-time features."""
    panel = calendar_features(episode_validity(df, statuses), "acquisition_date", "acquisition")
    panel = panel.withColumn("log_acquisition_price", F.ln("acquisition_price"))
    panel = structure_features(panel, "acquisition_year")
    return gross_spread(panel) if "resale_price" in panel.columns else panel
