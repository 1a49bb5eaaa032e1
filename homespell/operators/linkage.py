"""Ownership spells: each operator acquisition linked to its first later resale."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from homespell.operators.scale import OrderedGroups, join_on, order_groups
from homespell.schemas import ACQUISITION_ATTRIBUTES

DEED_KEY = ("parcel_id", "market", "sale_date", "sale_price", "buyer_operator", "seller_operator")
SPELL_KEY = ("market", "parcel_id", "operator")
#: Events that a task puts in order, about: 120 MB for each order.
TASK_EVENTS = 250_000


def operator_deeds(df: DataFrame, minimum_price: float = 10_000.0) -> DataFrame:
    return df.filter(
        F.col("sale_date").isNotNull() & (F.col("sale_price") >= minimum_price)
        & (F.col("buyer_operator").isNotNull() | F.col("seller_operator").isNotNull())
    )


def dedupe_deeds(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct deeds on the six-column key; the first ingested copy represents them."""
    rest = [name for name in df.columns if name not in DEED_KEY]
    first = F.min_by(F.struct(*rest), F.struct(seq)).alias("_first")
    # Structs are grouped by sorting, so a task would sort a whole split of a file; dealt out, it sorts a part of a shuffle, and
    # since copies have their own ``seq``, many of one deed are still combined by many tasks.
    return df.repartition(*DEED_KEY, seq).groupBy(*DEED_KEY).agg(first).select(*DEED_KEY, "_first.*").select(*df.columns)


def observation_end(df: DataFrame, latest_allowed: DataFrame | None = None,
                    minimum_price: float = 10_000.0) -> DataFrame:
    """Latest valid deed date per market, not later than the retrieval date when one is given."""
    valid = df.filter(F.col("sale_date").isNotNull() & (F.col("sale_price") >= minimum_price))
    if latest_allowed is not None:
        # One row per market, as in ``market_cutoff_join``.
        valid = valid.join(F.broadcast(latest_allowed), "market").filter(F.col("sale_date") <= F.col("latest"))
    return (
        valid.filter(F.col("market").isNotNull())
        .groupBy("market").agg(F.max("sale_date").alias("observation_end"))
    )


def missing_markets(required: DataFrame, provided: DataFrame) -> DataFrame:
    """Markets that have rows but no cutoff."""
    return required.select("market").distinct().join(
        provided.select("market").distinct(), "market", "left_anti"
    )


def market_cutoff_join(df: DataFrame, cutoffs: DataFrame | str | Mapping[str, str] | None) -> DataFrame:
    """Attach each market's as-of date and drop later rows.

    ``cutoffs`` is a date for all markets, a mapping, a (market, cutoff) table, or None for the
    latest date of each market. A market without cutoff is an error.
    """
    if isinstance(cutoffs, str):
        return df.withColumn("cutoff", F.lit(cutoffs).cast("date")).filter(
            F.col("sale_date") <= F.col("cutoff")
        )
    if cutoffs is None:
        table = df.groupBy("market").agg(F.max("sale_date").alias("cutoff"))
    else:
        if isinstance(cutoffs, Mapping):
            pairs = [(market, str(day)) for market, day in cutoffs.items()]
            table = df.sparkSession.createDataFrame(pairs, "market string, cutoff string")
        else:
            table = cutoffs
        table = table.select("market", F.col("cutoff").cast("date").alias("cutoff"))
        unknown = missing_markets(df.filter(F.col("market").isNotNull()), table).take(10)
        if unknown:
            raise ValueError(f"missing as-of dates for markets: {sorted(r[0] for r in unknown)}")
    # One row per market: joined where the rows lie, since all rows of a market would come to one task.
    return df.join(F.broadcast(table), "market").filter(F.col("sale_date") <= F.col("cutoff"))


def _mark_copies(events: OrderedGroups, seq: str) -> OrderedGroups:
    """``_copy``: an acquisition of a deed that has come before, by the key of ``dedupe_deeds``.

    Copies lie among the events of their day and price, so they are told in the order of the events, where no row moves for it and
    any number of copies of one deed is shared among ranges. A range is told of the deeds that have begun in one before.
    """
    event = [*SPELL_KEY, "sale_date", "sale_price", "role", "other"]
    bought = events.edges.filter(F.col("role") == 1)
    begun = bought.groupBy(*event).agg(F.min("_chunk").alias("_begun"), F.max("_chunk").alias("_last")).filter("_begun < _last").drop("_last")
    nth = F.row_number().over(Window.partitionBy(*event, "_chunk").orderBy(seq))

    def marked(df: DataFrame) -> DataFrame:
        known = join_on(df.withColumn("_nth", nth), F.broadcast(begun), event)
        again = (F.col("_nth") > 1) | (F.coalesce("_begun", "_chunk") < F.col("_chunk"))
        return known.withColumn("_copy", (F.col("role") == 1) & again).drop("_nth", "_begun")

    # Dealt by what the events' own order needs too, so that rows move once; a task sorts them for each of the two.
    parts = max(events.frame.sparkSession.sparkContext.defaultParallelism, events.frame.count() // TASK_EVENTS + 1)
    return replace(events, frame=marked(events.frame.repartition(parts, *SPELL_KEY, "_chunk")), edges=marked(events.edges))


def link_episodes(transactions: DataFrame, cutoffs=None, *, minimum_price: float = 10_000.0,
                  maximum_hold_days: int | None = 1_095, include_censored: bool = True,
                  seq: str = "seq",
                  attributes: Sequence[str] = ACQUISITION_ATTRIBUTES) -> DataFrame:
    """One row per acquisition with its exit, its successor acquisition or its censoring.

    Every deed becomes a seller event, a buyer event or both. A sale after the day of the latest
    acquisition before it is a resale, and a spell ends with the first resale or acquisition that follows
    its own; both are found in one order of the events.
    """
    if maximum_hold_days is not None and maximum_hold_days < 1:
        raise ValueError("maximum_hold_days must be positive or None")
    kept = [name for name in attributes if name in transactions.columns]
    deeds = market_cutoff_join(operator_deeds(transactions, minimum_price), cutoffs)
    sides = F.array(
        F.struct(F.col("seller_operator").alias("operator"), F.lit(0).alias("role"), F.col("buyer_operator").alias("other")),
        F.struct(F.col("buyer_operator").alias("operator"), F.lit(1).alias("role"), F.col("seller_operator").alias("other")),
    )
    events = (
        deeds.select("market", "parcel_id", "sale_date", "sale_price", seq, F.struct("cutoff", *kept).alias("at_start"),
                     F.inline(sides))
        .filter(F.col("operator").isNotNull())
        .withColumn("at_start", F.when(F.col("role") == 1, F.col("at_start")))
    )
    ordered = _mark_copies(order_groups(events, SPELL_KEY, ("sale_date", "sale_price", seq, "role", "other")), seq)
    acquired = (F.col("role") == 1) & ~F.col("_copy")
    opened = ordered.add(_acquired=F.when(acquired, F.col("sale_date"))).previous("_acquired", "_open")
    # A copy of a resale changes nothing: it ends what the first one ends, or lies on the day of an acquisition as that does.
    ending = acquired | ((F.col("role") == 0) & (F.col("sale_date") > F.col("_open")))
    linked = opened.add(
        _ending=F.when(ending, F.struct("role", "sale_date", "sale_price"))
    ).following("_ending", "_end").result()
    resold = F.col("_end.role") == 0
    spells = linked.filter(acquired).select(
        *SPELL_KEY, F.struct("sale_date", "sale_price").alias("spell"), "at_start",
        F.when(resold, F.struct("_end.sale_date", "_end.sale_price")).alias("exit"),
        F.when(~resold, F.col("_end.sale_date")).alias("next_acquisition"),
    )
    return _close_spells(spells, maximum_hold_days, include_censored, kept)


def _close_spells(spells: DataFrame, maximum: int | None, include_censored: bool,
                  kept: Sequence[str]) -> DataFrame:
    start, cutoff = F.col("spell.sale_date"), F.col("at_start.cutoff")
    exit_days = F.datediff("exit.sale_date", start)
    next_days = F.datediff("next_acquisition", start)
    cutoff_days = F.datediff(cutoff, start)
    if maximum is None:
        late, beyond = F.lit(False), F.lit(False)
        horizon = F.lit(None).cast("int")
    else:
        horizon = F.lit(maximum)
        late, beyond = exit_days > horizon, cutoff_days >= horizon
    status = (
        F.when(exit_days.isNotNull() & ~late, "completed")
        .when(exit_days.isNotNull(), "administrative_horizon")
        .when(next_days.isNotNull(), "repeat_acquisition_before_exit")
        .when(beyond, "administrative_horizon")
        .otherwise("right_censored")
    )
    hold = (
        F.when(F.col("linkage_status") == "completed", exit_days)
        .when(F.col("linkage_status") == "administrative_horizon", horizon)
        .when(F.col("linkage_status") == "repeat_acquisition_before_exit",
              F.least(next_days, horizon))
        .otherwise(cutoff_days)
    )
    done = F.col("linkage_status") == "completed"
    price, resale = F.col("spell.sale_price"), F.col("exit.sale_price")
    closed = spells.withColumn("linkage_status", status)
    if not include_censored:
        closed = closed.filter(done)
    return closed.select(
        "parcel_id", "market", "operator",
        start.alias("acquisition_date"), price.alias("acquisition_price"),
        F.when(done, F.col("exit.sale_date")).alias("resale_date"),
        F.when(done, resale).alias("resale_price"),
        F.greatest(F.lit(0), hold).cast("int").alias("hold_days"),
        done.alias("event_observed"), "linkage_status",
        F.when(done, resale - price).alias("gross_spread"),
        F.when(done, (resale - price) / price).alias("gross_return"),
        *[F.col(f"at_start.{name}").alias(name) for name in kept],
    )
