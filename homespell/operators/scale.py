"""Building blocks that keep ordered computations distributed however rows fall on keys.

Rows are range partitioned by (key, order), each range is processed by itself, and only one summary
row per range is carried forward to the next range of the same key. There is one plan for every
size: a key may hold any share of the rows. Values that can be merged are merged before.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from homespell.session import written

MASS_TOLERANCE = 1e-9
_CHUNK = "_chunk"


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which null keys match each other, as null groups do in a ``groupBy``."""
    renamed = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{key}"])
    joined = left.join(renamed, condition, how)
    return joined if how == "left_semi" else joined.drop(*[f"_right_{key}" for key in keys])


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, through one scalar subquery."""
    kept = [name for name in df.columns if name not in row.columns]
    attached = df.select(*kept, row.select(F.struct(*row.columns).alias("_row")).scalar().alias("_row"))
    return attached.select(*kept, *[F.col("_row")[name].alias(name) for name in row.columns])


@dataclass(frozen=True)
class Carried:
    """A fold of ``value`` along the order of a key.

    ``fold`` is sum, product, xor, last or first (the last or first non-null). ``over`` says which rows of the key it
    takes: ``upto`` a row, ``before`` it, ``onward`` from it, or ``all`` of them (not for last); for first ``after`` a row.
    """

    value: str
    fold: str = "sum"
    over: str = "upto"


_FOLDS = {"sum": F.sum, "product": F.product, "xor": F.bit_xor}
_FRAMES = {
    "upto": (Window.unboundedPreceding, 0),
    "before": (Window.unboundedPreceding, -1),
    "onward": (Window.unboundedPreceding, 0),
    "all": (Window.unboundedPreceding, Window.unboundedFollowing),
}


def _joined(fold: str, parts: Sequence[Column]) -> Column:
    """Folds of several row sets as one; sets without a value are null and pass."""
    out = parts[0]
    for part in parts[1:]:
        both = {"sum": out + part, "product": out * part, "xor": out.bitwiseXOR(part)}[fold]
        out = F.coalesce(both, out, part)
    return out


@dataclass(frozen=True)
class OrderedGroups:
    """Rows in a total order within each key, ready for running computations.

    ``order`` must identify rows up to harmless ties, so that a range boundary can fall anywhere
    inside a group. ``edges`` are the rows of the first and the last key of each range, the only keys that may go on in another.
    They get the columns that ``frame`` gets, so that nothing is worked out for all rows to sum up these.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    edges: DataFrame | None = None

    def add(self, **columns: Column) -> OrderedGroups:
        """Add columns that are worked out from a row alone."""
        return self._with(lambda df: df.withColumns(columns))

    def _with(self, step: Callable[[DataFrame], DataFrame]) -> OrderedGroups:
        return replace(self, frame=step(self.frame), edges=None if self.edges is None else step(self.edges))

    def carry(self, **outs: Carried) -> OrderedGroups:
        """Add a column for each fold, all in one aggregate, one pass over the rows and one join.

        Rows are folded within their range; keys that go over a range's end, of which a range has two at
        most, get what their other ranges hold from a table with fewer than twice as many rows as there are
        ranges, which is safe to broadcast. Only rows of such keys are summed up for it.
        """
        # A frame that ends with its partition is worked out anew for each row, so what follows is read backwards.
        within, ranges = Window.partitionBy(*self.keys, _CHUNK), Window.partitionBy(*self.keys)
        rows, backwards = within.orderBy(*self.order), within.orderBy(*[F.desc_nulls_last(name) for name in self.order])
        sides = {"before": ranges.orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1),
                 "after": ranges.orderBy(F.desc(_CHUNK)).rowsBetween(Window.unboundedPreceding, -1)}
        own, summaries, others, merged = {}, [], {}, {}
        for out, it in outs.items():
            if it.fold == "first":
                # Not a frame to the end: what follows a row is looked up once for all rows before it.
                own[out] = F.expr(f"lead(`{it.value}`) IGNORE NULLS").over(rows)
                position = F.when(F.col(it.value).isNotNull(), F.struct(*self.order))
                summaries.append(F.min_by(it.value, position).alias(f"_sum_{out}"))
                others[f"_after_{out}"] = F.last(f"_sum_{out}", ignorenulls=True).over(sides["after"])
                merged[out] = F.coalesce(out, f"_after_{out}")
                continue
            window = (backwards if it.over == "onward" else rows).rowsBetween(*_FRAMES[it.over])
            if it.fold == "last":
                own[out] = F.last(it.value, ignorenulls=True).over(window)
                position = F.when(F.col(it.value).isNotNull(), F.struct(*self.order))
                summaries.append(F.max_by(it.value, position).alias(f"_sum_{out}"))
                others[f"_before_{out}"] = F.last(f"_sum_{out}", ignorenulls=True).over(sides["before"])
                merged[out] = F.coalesce(out, f"_before_{out}")
                continue
            fold = _FOLDS[it.fold]
            own[out] = fold(it.value).over(window)
            summaries.append(fold(it.value).alias(f"_sum_{out}"))
            needed = {"upto": ["before"], "before": ["before"], "onward": ["after"], "all": ["before", "after"]}[it.over]
            others |= {f"_{side}_{out}": fold(F.col(f"_sum_{out}")).over(sides[side]) for side in needed}
            merged[out] = _joined(it.fold, [F.col(out), *[F.col(f"_{side}_{out}") for side in needed]])
        known = reduce(or_, [F.col(name).isNotNull() for name in others])
        carried = ((self.frame if self.edges is None else self.edges).groupBy(*self.keys, _CHUNK).agg(*summaries).withColumns(others)
                   .filter(known).select(*self.keys, _CHUNK, *others))
        return self._with(lambda df: join_on(df.withColumns(own), F.broadcast(carried), [*self.keys, _CHUNK])
                          .withColumns(merged).drop(*others))

    def previous(self, value: str, out: str) -> OrderedGroups:
        """Last non-null ``value`` strictly before each row."""
        return self.carry(**{out: Carried(value, "last", "before")})

    def following(self, value: str, out: str) -> OrderedGroups:
        """First non-null ``value`` strictly after each row."""
        return self.carry(**{out: Carried(value, "first", "after")})

    def running_sum(self, value: str, out: str) -> OrderedGroups:
        """Sum of ``value`` up to and including each row."""
        return self.carry(**{out: Carried(value)})

    def totals(self, value: str, out: str) -> OrderedGroups:
        """Sum of ``value`` over each whole key."""
        return self.carry(**{out: Carried(value, over="all")})

    def result(self) -> DataFrame:
        return self.frame.drop(_CHUNK)


def order_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> OrderedGroups:
    """Deal the rows to ranges of (key, order)."""
    # The range id must be read back, never recomputed: a second sampling could move the bounds.
    ranged = df.repartitionByRange(*keys, *order).withColumn(_CHUNK, F.spark_partition_id())
    frame = written(ranged, "ordered")
    if not keys:
        return OrderedGroups(frame, (), tuple(order))
    ends = frame.groupBy(_CHUNK).agg(*[end(F.struct(*keys)).alias(name) for name, end in (("_first", F.min), ("_last", F.max))])
    outer = ends.select(F.inline(F.array("_first", "_last")), _CHUNK)
    edges = written(join_on(frame, F.broadcast(outer), [*keys, _CHUNK], "left_semi"), "edges")
    return OrderedGroups(frame, tuple(keys), tuple(order), edges)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Mapping[str, float],
    count: str | None = None,
) -> DataFrame:
    """Interpolated percentiles per key; nulls are ignored, keys without values are absent.

    ``count``: column that says how many rows a row stands for.
    """
    many = F.lit(1) if count is None else F.col(count)
    present = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value"), many.cast("bigint").alias("_n"))
    counts = present.groupBy(*keys, "_value").agg(F.sum("_n").alias("_n"))
    ranked = (
        order_groups(counts, keys, ["_value"])
        .carry(_upto=Carried("_n"), _total=Carried("_n", over="all"))
        .result()
    )
    picks, outputs = [], []
    for index, (name, p) in enumerate(fractions.items()):
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.min(F.when(F.col("_upto") > low, F.col("_value"))).alias(f"_low{index}"),
            F.min(F.when(F.col("_upto") > high, F.col("_value"))).alias(f"_high{index}"),
            F.max(position - low).alias(f"_part{index}"),
        ]
        outputs.append(
            (
                F.col(f"_low{index}")
                + (F.col(f"_high{index}") - F.col(f"_low{index}")) * F.col(f"_part{index}")
            ).alias(name)
        )
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outputs)


def weighted_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    fractions: Mapping[str, float],
) -> DataFrame:
    """First sorted value whose share of the cumulative weight reaches each fraction."""
    merged = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.sum(weight).alias("_w"))
    )
    ranked = (
        order_groups(merged, keys, ["_value"])
        .carry(_upto=Carried("_w"), _total=Carried("_w", over="all"))
        .result()
    )
    share = F.col("_upto") / F.col("_total") + MASS_TOLERANCE
    return ranked.groupBy(*keys).agg(
        *[
            F.coalesce(F.min(F.when(share >= q, F.col("_value"))), F.max("_value")).alias(name)
            for name, q in fractions.items()
        ]
    )


def rank_positions(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Zero-based position of every row in one global order."""
    ordered = order_groups(df.withColumn("_one", F.lit(1).cast("bigint")), (), order)
    return ordered.running_sum("_one", out).result().withColumn(out, F.col(out) - 1).drop("_one")


def stacked(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], *also: str) -> DataFrame:
    """One row per row and column of ``values``: (keys, also, measure, value), named by the mapping."""
    rows = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(column).cast("double").alias("value"))
                     for column, name in values.items()])
    return df.select(*keys, *also, F.inline(rows))


def unstacked(df: DataFrame, keys: Sequence[str], names: Sequence[str], value: str) -> DataFrame:
    """The measures of ``stacked`` as columns again."""
    return df.groupBy(*keys).agg(
        *[F.max(F.when(F.col("measure") == name, F.col(value))).alias(name) for name in names])
