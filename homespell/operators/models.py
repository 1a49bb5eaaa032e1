"""Estimators on Spark ML: feature preparation, logits, conformal regressions and the two studies."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.functions import contracts as C
from homespell.functions import pricing as P
from homespell.operators import conformal, metrics, panels, splits, survival
from homespell.operators.scale import Carried, exact_percentiles, order_groups, stacked
from homespell.session import materialize, scratch_path, shared_dir, ship

MISSING = "__missing__"
#: Bins of a numeric feature of boosted trees.
BINS = 32


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    drop_first: bool = False
    scale: bool = True
    minimum_count: int = 1

    def __post_init__(self) -> None:
        if not self.numeric and not self.categorical:
            raise ValueError("at least one feature is required")
        if set(self.numeric) & set(self.categorical):
            raise ValueError("a feature cannot be both numeric and categorical")


@dataclass(frozen=True)
class Features:
    """Fitted preparation: imputation and scaling as plain expressions, one-hot by codes that are joined on.

    ``labels`` holds the code of each category (name, label, code), ranked where it lies; ``sizes`` how many a feature
    has. The labels themselves come to the driver only where somebody asks for ``names`` or ``vocabulary``, as a table of
    coefficients does. Where ``edges`` holds thresholds of a numeric feature, the number of those below a value stands for it.
    """

    spec: FeatureSpec
    medians: dict[str, float]
    centers: dict[str, tuple[float, float]]
    modes: dict[str, str]
    frequent: dict[str, DataFrame]
    sizes: dict[str, int] = field(default_factory=dict)
    labels: DataFrame | None = None
    encoder: OneHotEncoderModel | None = None
    out: str = "features"
    given_names: tuple[str, ...] | None = None
    given_vocabulary: dict[str, tuple] | None = None
    edges: dict[str, tuple[float, ...]] = field(default_factory=dict)

    @functools.cached_property
    def vocabulary(self) -> dict[str, tuple]:
        if self.given_vocabulary is not None:
            return self.given_vocabulary
        rows = [] if self.labels is None else self.labels.orderBy("name", "code").collect()
        return {name: tuple(r["label"] for r in rows if r["name"] == name) for name in self.spec.categorical}

    @functools.cached_property
    def names(self) -> tuple[str, ...]:
        if self.given_names is not None:
            return self.given_names
        first = int(self.spec.drop_first)
        return (*self.spec.numeric, *[f"{name}_{label}" for name in self.spec.categorical for label in self.vocabulary[name][first:]])

    def _prepared(self, df: DataFrame) -> DataFrame:
        added = {}
        for name, kept in self.frequent.items():
            common = kept.select(F.col("v").alias(f"_k_{name}"))
            df = df.join(common, F.coalesce(F.col(name).cast("string"), F.lit(self.modes[name])) == F.col(f"_k_{name}"), "left")
        for name in self.spec.numeric:
            mean, deviation = self.centers[name]
            value = F.coalesce(F.col(name).cast("double"), F.lit(self.medians[name]))
            if name in self.edges:
                value = functools.reduce(add, [(value > edge).cast("int") for edge in self.edges[name]], F.lit(0)).cast("double")
            added[f"_n_{name}"] = (value - mean) / deviation
        for name in self.spec.categorical:
            value = F.coalesce(F.col(name).cast("string"), F.lit(self.modes[name]))
            if name in self.frequent:
                value = F.coalesce(f"_k_{name}", F.lit("__rare__"))
            added[f"_c_{name}"] = value
        return df.withColumns(added).drop(*[f"_k_{name}" for name in self.frequent])

    def cells(self, df: DataFrame, label: Column) -> DataFrame:
        """Rows with equal features as one, with their mean ``_label`` and their number ``_many``."""
        by = [f"_n_{name}" for name in self.spec.numeric] + [f"_c_{name}" for name in self.spec.categorical]
        # A missing label makes the mean NaN, which estimators refuse, as they do a missing label.
        rows = self._prepared(df.withColumn("_label", F.coalesce(label, F.lit(float("nan")))))
        return rows.groupBy(*by).agg(F.avg("_label").alias("_label"), F.count(F.lit(1)).cast("double").alias("_many"))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.assembled(self._prepared(df))

    def assembled(self, out: DataFrame) -> DataFrame:
        coded = self._coded()
        for name in coded:
            own = self.labels.filter(F.col("name") == name).select(F.col("label").alias("_label"), F.col("code").alias("_code"))
            # What is unseen, and a dropped first category, gets the code past the last, which the encoder leaves out.
            code = F.col("_code") - int(self.spec.drop_first)
            out = (out.join(own, F.col(f"_c_{name}") == F.col("_label"), "left")
                   .withColumn(f"_i_{name}", F.when(code >= 0, code).otherwise(coded[name]).cast("double")).drop("_label", "_code"))
        if self.encoder is not None:
            out = self.encoder.transform(out)
        parts = [f"_n_{c}" for c in self.spec.numeric] + [f"_o_{c}" for c in coded]
        out = VectorAssembler(inputCols=parts, outputCol=self.out).transform(out)
        drop = [c for c in out.columns if c.startswith(("_n_", "_c_", "_i_", "_o_"))]
        return out.drop(*drop)

    def _coded(self) -> dict[str, int]:
        """Features with indicators and the number of these."""
        sizes = {name: size - int(self.spec.drop_first) for name, size in self.sizes.items()}
        return {name: size for name, size in sizes.items() if size > 0}


def _stacked_categories(df: DataFrame, names: dict[str, str], *also: str) -> DataFrame:
    """``name, v`` and the columns of ``also``, a row for each row and column of ``names``, by its name."""
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(column).cast("string").alias("v")) for name, column in names.items()])
    return df.select(*also, F.inline(rows))


def fit_statistics(df: DataFrame, spec: FeatureSpec, count: str | None = None) -> Features:
    """Median and population scaling for numerics, most frequent and frequent values for the rest, without an encoder.

    Statistics are combined aggregates; only one row per feature reaches the driver. ``count``: column that says how many
    rows a row stands for.
    """
    many = F.lit(1) if count is None else F.col(count)
    medians, centers, modes, frequent = {}, {}, {}, {}
    numeric = df.select(*[F.col(c).cast("double").alias(c) for c in spec.numeric], many.alias("_many"))
    if spec.numeric:
        values = stacked(numeric, [], {c: c for c in spec.numeric}, "_many")
        middle = exact_percentiles(values, ["measure"], "value", {"m": 0.5}, "_many")
        medians = {c: 0.0 for c in spec.numeric} | {r["measure"]: r["m"] for r in middle.collect()}
    if spec.numeric and spec.scale:
        filled = numeric.fillna(medians)
        mean = filled.agg(*[(F.sum(F.col(c) * F.col("_many")) / F.sum("_many")).alias(c) for c in spec.numeric]).first()
        spread = filled.agg(*[F.sqrt(F.sum((F.col(c) - mean[c]) ** 2 * F.col("_many")) / F.sum("_many")).alias(c) for c in spec.numeric]).first()
        centers = {c: (mean[c], spread[c] or 1.0) for c in spec.numeric}
    else:
        centers = {c: (0.0, 1.0) for c in spec.numeric}
    if spec.categorical:
        held = df.withColumn("_many", many)
        counts = materialize(_stacked_categories(held, {c: c for c in spec.categorical}, "_many").filter(F.col("v").isNotNull())
                             .groupBy("name", "v").agg(F.sum("_many").alias("count")))
        tops = counts.groupBy("name").agg(F.min_by("v", F.struct(-F.col("count"), "v")).alias("v")).collect()
        modes = {c: MISSING for c in spec.categorical} | {r["name"]: r["v"] for r in tops}
        if spec.minimum_count > 1:
            frequent = {c: counts.filter((F.col("name") == c) & (F.col("count") >= spec.minimum_count)).select("v") for c in spec.categorical}
    return Features(spec, medians, centers, modes, frequent)


def fit_features(df: DataFrame, spec: FeatureSpec, out: str = "features") -> Features:
    """``fit_statistics`` with one-hot indicators; categories are ranked where they lie, in one scan for all features."""
    draft = replace(fit_statistics(df, spec), out=out)
    if not spec.categorical:
        return draft
    seen = _stacked_categories(draft._prepared(df), {c: f"_c_{c}" for c in spec.categorical}).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    ranked = order_groups(seen.withColumnRenamed("v", "label"), ["name"], ["label"]).carry(code=Carried("_one")).result()
    labels = materialize(ranked.select("name", "label", (F.col("code") - 1).alias("code")))
    sizes = {r["name"]: r["n"] for r in labels.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = replace(draft, labels=labels, sizes={c: sizes[c] for c in spec.categorical if c in sizes})
    coded = fitted._coded()
    if not coded:
        return fitted
    # The encoder takes its sizes from one row that holds the last code of each feature.
    last = df.sparkSession.createDataFrame([tuple(float(size - 1) for size in coded.values())], ", ".join(f"`_i_{c}` double" for c in coded))
    encoder = OneHotEncoder(inputCols=[f"_i_{c}" for c in coded], outputCols=[f"_o_{c}" for c in coded], handleInvalid="keep")
    return replace(fitted, encoder=encoder.fit(last))


def bin_edges(df: DataFrame, names: Sequence[str], bins: int = BINS) -> dict[str, tuple[float, ...]]:
    """Thresholds that part the rows into at most ``bins`` bins of nearly equal size, for each column, by all its values.

    A column of at most ``bins`` values has one between any two neighbours. Else the k-th lies before the first value at which
    more than half of its copies are beyond k / bins of the rows, and past the threshold before it.
    """
    values = stacked(df, [], {name: name for name in names})
    counts = values.groupBy("measure", "value").agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = order_groups(counts, ["measure"], ["value"]).carry(
        _upto=Carried("_n"), _total=Carried("_n", over="all"), _at=Carried("_one"), _values=Carried("_one", over="all"),
        _low=Carried("value", "last", "before"), _below=Carried("_n", "last", "before")).result()
    parts = F.least(F.lit(bins), F.col("_total"))
    # How many k there are from 1 on, plus one, with k / parts of the rows before the middle of a value's copies.
    passed = lambda twice: F.greatest(F.lit(1), F.ceil(twice * parts / (2 * F.col("_total"))))
    before = F.when(F.col("_at") > 2, 2 * (F.col("_upto") - F.col("_n")) - F.col("_below")).otherwise(0)
    targets = passed(2 * F.col("_upto") - F.col("_n")) - passed(before)
    inner = ranked.filter(F.col("_at") > 1).select("measure", "_at", parts.alias("parts"), "_values", targets.alias("targets"),
                                                   ((F.col("_low") + F.col("value")) / 2).alias("edge"))
    rows = inner.filter((F.col("_values") <= F.col("parts")) | (F.col("targets") > 0)).collect()
    edges = {}
    for name in names:
        own = sorted((row["_at"], row["edge"], row["targets"]) for row in rows if row["measure"] == name)
        some = next((row for row in rows if row["measure"] == name), None)
        if some is None or some["_values"] <= some["parts"]:
            edges[name] = tuple(edge for _, edge, _ in own)
            continue
        places, last = [], 1
        for at, _, targets in own:
            for _ in range(targets):
                last = max(at, last + 1)
                places.append(last)
        places = [at for at in places[:some["parts"] - 1] if at <= some["_values"]]
        known = {at: edge for at, edge, _ in own}
        if set(places) - set(known):  # values with more copies than a bin holds
            more = inner.filter((F.col("measure") == name) & F.col("_at").isin(places)).collect()
            known |= {row["_at"]: row["edge"] for row in more}
        edges[name] = tuple(known[at] for at in places)
    return edges


@dataclass(frozen=True)
class LogitModel:
    features: Features
    coefficients: tuple[float, ...]
    intercept: float
    model: object

    def transform(self, df: DataFrame, out: str = "probability") -> DataFrame:
        scored = self.model.transform(self.features.transform(df))
        return scored.withColumn(out, vector_to_array("_probability")[1]).drop(
            "features", "_probability", "_raw", "_prediction")

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        if not 0 < threshold < 1:
            raise ValueError("threshold must lie strictly between zero and one")
        return self.transform(df).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))

    def coefficient_table(self, spark) -> DataFrame:
        rows = sorted(zip(self.features.names, self.coefficients, strict=True), key=lambda r: -r[1])
        return spark.createDataFrame([(n, float(c)) for n, c in rows], "feature string, coefficient double")

    def effects(self, spark, column: str) -> DataFrame:
        """Log-odds difference and odds ratio of each level against the dropped first level."""
        by_name = dict(zip(self.features.names, self.coefficients, strict=True))
        rows = []
        for i, level in enumerate(self.features.vocabulary[column]):
            effect = float(by_name.get(f"{column}_{level}", 0.0))
            rows.append((level, i == 0, effect))
        table = spark.createDataFrame(rows, f"{column} string, reference boolean, log_hazard_difference double")
        return table.withColumn("hazard_odds_ratio", F.exp("log_hazard_difference"))


def fit_logit(df: DataFrame, label: str, spec: FeatureSpec, regularization: float = 1.0,
              outcomes: frozenset[str] = frozenset()) -> LogitModel:
    """Ridge-penalized logit; the penalty counts once per sample, hence the division by n."""
    if regularization <= 0:
        raise ValueError("regularization must be positive")
    C.guard_features((*spec.numeric, *spec.categorical), outcomes)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("ones")).first()
    if not size["n"] or not 0 < size["ones"] < size["n"]:
        raise ValueError("the outcome must contain both classes")
    prepared = fit_features(df, spec)
    estimator = LogisticRegression(
        featuresCol="features", labelCol="_label", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction", regParam=regularization / size["n"],
        elasticNetParam=0.0, standardization=False, maxIter=1_000, tol=1e-7)
    trained = estimator.fit(prepared.transform(df).withColumn("_label", F.col(label).cast("double")))
    # The trained object drags its training summary, and with it the session, into every task;
    # the stored model does not.
    path = scratch_path(df.sparkSession, "logit")
    trained.write().save(path)
    fitted = LogisticRegressionModel.load(path)
    return LogitModel(prepared, tuple(float(c) for c in fitted.coefficients), float(fitted.intercept), fitted)


def fit_acceptance(offers: DataFrame, spec: FeatureSpec, label: str = "accepted",
                   regularization: float = 1.0) -> LogitModel:
    return fit_logit(offers, label, spec, regularization)


@dataclass(frozen=True)
class HazardModel(LogitModel):
    """Discrete-time hazard: a logit that is linear in the covariates, with an effect per period."""

    def transform(self, df: DataFrame, out: str = "hazard") -> DataFrame:
        """Hazard of rows with a ``period``; unseen periods and categories have no effect."""
        effect = dict(zip(self.features.names, self.coefficients, strict=True))
        score = F.lit(self.intercept)
        for name in self.features.spec.numeric:
            score = score + effect[name] * F.col(f"_n_{name}")
        for name in (*self.features.spec.categorical, "period"):
            levels = {level: effect.get(self._named(name, level)) for level in self.features.vocabulary[name]}
            known = [F.lit(x) for level, value in levels.items() if value for x in (level, value)]
            if known:
                own = F.col("period").cast("int") if name == "period" else F.col(f"_c_{name}")
                score = score + F.coalesce(F.try_element_at(F.create_map(*known), own), F.lit(0.0))
        prepared = self.features._prepared(df).withColumn(out, 1 / (1 + F.exp(-score)))
        return prepared.drop(*[c for c in prepared.columns if c.startswith(("_n_", "_c_"))])

    @staticmethod
    def _named(name: str, level) -> str:
        return f"period_label_period_{level:03d}" if name == "period" else f"{name}_{level}"


def spell_cells(df: DataFrame, spec: FeatureSpec, max_periods: int, duration: str, event: str) -> DataFrame:
    """Spells of equal covariates, last period at risk and outcome as one row with their number ``spells``.

    Durations above ``max_periods`` end there without an event; ``rows`` is the number of unit-periods.
    """
    if max_periods < 1:
        raise ValueError("max_periods must be positive")
    length = F.col(duration).cast("int")
    last, seen = F.least(length, F.lit(max_periods)), F.col(event).cast("boolean") & (length <= max_periods)
    cells = (df.filter(length >= 1).groupBy(*spec.numeric, *spec.categorical, last.alias("last"), F.coalesce(seen, F.lit(False)).alias("exit"))
             .agg(F.count(F.lit(1)).alias("spells")))
    return materialize(cells.withColumn("rows", F.col("spells") * F.col("last")))


def _newton_terms(cells: DataFrame, columns: Sequence[str], levels: dict[str, dict[str, int]], size: int,
                  periods: int, point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the unpenalized hazard logit, summed over the cells where they lie.

    ``point`` holds intercept, covariate effects and period effects. A cell's periods are looked at in place, so no unit
    becomes several rows; (1 + effects)^2 sums leave a task.
    """
    width = 1 + size + periods

    def run(batches):
        sums = np.zeros(1 + width + width * width)
        gradient, hessian = sums[1:1 + width], sums[1 + width:].reshape(width, width)
        for batch in batches:
            last = batch.column("last").to_numpy()
            # Cells at risk in a period come first.
            order = np.argsort(-last, kind="stable")
            last, exits = last[order], batch.column("exit").to_numpy(zero_copy_only=False)[order]
            many = batch.column("spells").to_numpy()[order].astype(float)
            x = np.zeros((len(last), 1 + size))
            x[:, 0] = 1
            for at, name in enumerate(columns):
                x[:, 1 + at] = batch.column(name).to_numpy(zero_copy_only=False)[order]
            for name, codes in levels.items():
                code = np.array([codes.get(v, 0) for v in batch.column(name).to_pylist()], np.int64)[order]
                rows = np.flatnonzero(code)
                x[rows, code[rows]] = 1
            base, rest, weight = x @ point[:1 + size], np.zeros(len(last)), np.zeros(len(last))
            for period in range(1, int(last.max(initial=0)) + 1):
                live = int(np.searchsorted(-last, -period, side="right"))
                score = base[:live] + point[size + period]
                chance = 1 / (1 + np.exp(-score))
                expected, curve = many[:live] * chance, many[:live] * chance * (1 - chance)
                ended = exits[:live] & (last[:live] == period)
                sums[0] += (many[:live] * np.logaddexp(0, score)).sum() - (many[:live] * score)[ended].sum()
                expected[ended] -= many[:live][ended]
                rest[:live] += expected
                weight[:live] += curve
                gradient[size + period] += expected.sum()
                hessian[size + period, size + period] += curve.sum()
                hessian[size + period, :1 + size] += curve @ x[:live]
            gradient[:1 + size] += rest @ x
            hessian[:1 + size, :1 + size] += (x.T * weight) @ x
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["at", "value"])

    ship(cells.sparkSession)
    found = cells.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(1 + width + width * width)
    for row in found:
        total[row["at"]] = row["value"]
    hessian = total[1 + width:].reshape(width, width)
    hessian[:1 + size, 1 + size:] = hessian[1 + size:, :1 + size].T
    return total[0], total[1:1 + width], hessian


def fit_hazard(df: DataFrame, spec: FeatureSpec, max_periods: int, duration: str, event: str,
               regularization: float = 1.0) -> HazardModel:
    """Discrete-time hazard logit with an indicator per period, by Newton steps over ``spell_cells``.

    Each step is one pass that sums gradient and Hessian; the ridge penalty leaves out the intercept. All
    covariates' categories and periods are columns of the Hessian, so their number must suit a dense matrix.
    """
    if regularization <= 0:
        raise ValueError("regularization must be positive")
    C.guard_features((*spec.numeric, *spec.categorical), C.EXIT_OUTCOMES)
    cells = spell_cells(df, spec, max_periods, duration, event)
    size = cells.agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("exit"), F.col("spells"))).alias("ones"), F.max("last").alias("last")).first()
    if not size["n"] or not 0 < (size["ones"] or 0) < size["n"]:
        raise ValueError("the outcome must contain both classes")
    draft = fit_statistics(cells, spec, "rows")
    prepared = materialize(draft._prepared(cells).select(*[f"_n_{c}" for c in spec.numeric], *[f"_c_{c}" for c in spec.categorical], "last", "exit", "spells"))
    vocabulary, names, levels = {}, list(spec.numeric), {}
    for name in spec.categorical:
        labels = sorted(r[0] for r in prepared.select(f"_c_{name}").distinct().collect())
        vocabulary[name] = tuple(labels)
        kept = labels[1:] if spec.drop_first else labels
        levels[f"_c_{name}"] = {label: 1 + len(names) + at for at, label in enumerate(kept)}
        names += [f"{name}_{label}" for label in kept]
    periods, width = size["last"], len(names)
    vocabulary["period"] = tuple(range(1, periods + 1))
    ridge = np.full(1 + width + periods, float(regularization))
    ridge[0] = 0.0
    free = np.ones(1 + width + periods, bool)
    if spec.drop_first:
        free[1 + width] = False

    point, step, best = np.zeros(1 + width + periods), np.zeros(1 + width + periods), np.inf
    for _ in range(100):
        loss, gradient, hessian = _newton_terms(prepared, [f"_n_{c}" for c in spec.numeric], levels, width, periods, point + step)
        loss += 0.5 * ridge @ (point + step) ** 2
        if loss > best + 1e-9 * abs(best):
            step /= 2
            continue
        point, best = point + step, loss
        gradient, hessian = gradient + ridge * point, hessian + np.diag(ridge)
        step = np.zeros_like(point)
        step[free] = -np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        if np.abs(step).max() < 1e-9:
            break
    names += [HazardModel._named("period", k) for k in vocabulary["period"]]
    kept = [at for at in range(len(names)) if free[1 + at]]
    features = replace(draft, given_names=tuple(names[at] for at in kept), given_vocabulary=vocabulary)
    return HazardModel(features, tuple(float(point[1 + at]) for at in kept), float(point[0]), None)


def fit_operator_hazard(df: DataFrame, spec: FeatureSpec, max_weeks: int = 156,
                        regularization: float = 1.0) -> HazardModel:
    """Hazard logit with operator indicators, each categorical against its first level."""
    full = FeatureSpec(spec.numeric, (*spec.categorical, "operator"), True)
    return fit_hazard(df, full, max_weeks, "duration_weeks", "event_observed", regularization)


def score_hazard(model: HazardModel, rows: DataFrame) -> DataFrame:
    """Hazard of rows that already have a ``period``."""
    return model.transform(rows, "hazard")


def score_states(model: HazardModel, lattice: DataFrame, homes: DataFrame | None = None, lead: str | None = None,
                 reference: str = "prelisting_reference", feature: str = "list_price_premium",
                 support=P.LIST_PREMIUM_SUPPORT) -> DataFrame:
    """Hazard of every (lead, week, price) state of a lattice, in one pass.

    ``homes`` holds the covariates; a lattice that kept them needs none, and then no state is moved.
    """
    joined = lattice if homes is None else lattice.join(homes.drop(feature), lead)
    premium, inside = P.list_premium(F.col("cents") / 100.0, F.col(reference), support)
    states = joined.withColumns({feature: premium, "in_support": inside, "period": F.col("week") + 1})
    return score_hazard(model, states)


def hazard_terms(model: HazardModel, homes: DataFrame, weeks: int, *groups: str,
                 feature: str = "list_price_premium") -> DataFrame:
    """Terms of a fitted hazard that is linear in the premium: ``hazard_score`` (log odds of week one at
    premium zero), ``premium_effect`` per unit and ``week_effects`` against week one, joined by ``groups``."""
    step = 0.1
    cells = (homes.select(*groups).distinct()
             .withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(weeks))))
             .withColumn(feature, F.explode(F.array(F.lit(0.0), F.lit(step)))))
    odds = F.ln(F.col("hazard") / (1 - F.col("hazard")))
    at = lambda period, premium: F.max(F.when((F.col("period") == period) & (F.col(feature) == premium), odds))
    listed = F.array_sort(F.collect_list(F.when(F.col(feature) == 0, F.struct("period", odds.alias("odds")))))
    terms = score_hazard(model, cells).groupBy(*groups).agg(
        at(1, 0.0).alias("hazard_score"), ((at(1, step) - at(1, 0.0)) / step).alias("premium_effect"), listed.alias("_listed"))
    return homes.join(terms.withColumn("week_effects", F.transform("_listed", lambda x: x["odds"] - F.col("hazard_score"))).drop("_listed"),
                      list(groups))


def offer_curve(model: LogitModel, df: DataFrame, ratios: Sequence[float],
                feature: str = "offer_ratio") -> DataFrame:
    """Mean acceptance over the rows at each counterfactual offer ratio."""
    grid = F.explode(F.array(*[F.lit(float(r)) for r in ratios]))
    crossed = df.drop(feature).withColumn(feature, grid)
    return model.transform(crossed).groupBy(feature).agg(
        F.avg("probability").alias("acceptance_probability"))


def response_effect(curve: DataFrame, low: float, high: float, feature: str = "offer_ratio",
                    value: str = "acceptance_probability", truth: float | None = None) -> DataFrame:
    """Log-odds contrast between two treatment values, its sign, and its error against a truth."""
    def at(level):
        return F.max(F.when(F.abs(F.col(feature) - level) < 1e-9, P.logit(F.col(value), 1e-9)))

    return curve.agg((at(high) - at(low)).alias("log_odds_effect")).select(
        "log_odds_effect", (F.col("log_odds_effect") > 0).alias("increasing"),
        F.abs(F.col("log_odds_effect") - F.lit(truth)).cast("double").alias("recovery_error"))


@dataclass(frozen=True)
class ConformalModel:
    features: Features
    model: object
    radius: float
    n_scores: int
    scale: str | None

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction, lower and upper next to the source columns."""
        raw = self.model.transform(self.features.transform(df)).withColumnRenamed("_raw", "_value")
        factor = F.col(self.scale) if self.scale else F.lit(1.0)
        return raw.withColumns({
            "prediction": F.exp("_value") * factor,
            "lower": F.exp(F.col("_value") - self.radius) * factor,
            "upper": F.exp(F.col("_value") + self.radius) * factor,
        }).drop("features", "_value")


def _fit_conformal(training: DataFrame, calibration: DataFrame, target: str, spec: FeatureSpec,
                   estimator, alpha: float, group: str, scale: str | None,
                   outcomes=C.SALE_OUTCOMES, bins: int | None = None) -> ConformalModel:
    """``bins``: numeric features are binned, and the estimator, which must take weights, is fitted on cells of equal features."""
    C.guard_features((*spec.numeric, *spec.categorical), outcomes)
    factor = F.col(scale) if scale else F.lit(1.0)
    label = F.ln(F.col(target) / factor)
    prepared = fit_features(training, spec)
    if bins is None:
        model = estimator.fit(prepared.transform(training).withColumn("_label", label))
    else:
        filled = training.select(*[F.coalesce(F.col(c).cast("double"), F.lit(prepared.medians[c])).alias(c) for c in spec.numeric])
        prepared = replace(prepared, edges=bin_edges(filled, spec.numeric, bins) if spec.numeric else {})
        model = estimator.fit(prepared.assembled(materialize(prepared.cells(training, label))))
    scored = model.transform(prepared.transform(calibration)).withColumn(
        "residual", label - F.col("_raw"))
    row = conformal.conformal_radius(scored.select(group, "residual"), alpha, group=group).first()
    return ConformalModel(prepared, model, row["interval_radius"], row["n_scores"], scale)


def fit_linear_conformal(df: DataFrame, target: str, spec: FeatureSpec, *, row_key: str,
                         alpha: float = 0.1, calibration_fraction: float = 0.2,
                         seed: int = 0) -> ConformalModel:
    """Log-price least squares with an interval calibrated on a random share of the rows."""
    parted = splits.grouped_split(df, F.col(row_key).cast("string"), calibration_fraction, seed)
    estimator = LinearRegression(featuresCol="features", labelCol="_label", predictionCol="_raw",
                                 regParam=0.0, solver="auto")
    held = parted.filter("is_calibration")
    if held.limit(10).count() < 10:
        raise ValueError("at least ten calibration rows are required")
    return _fit_conformal(parted.filter("NOT is_calibration"), held, target, spec, estimator, alpha,
                          row_key, None)


def guard_samples(training: DataFrame, calibration: DataFrame, group: str, *, rows: tuple[int, int] = (30, 10),
                  groups: tuple[int, int] = (15, 5)) -> None:
    """Refuse samples that are too small or share groups; looks at no more rows than it must."""
    for part, name, least, parcels in ((training, "training", rows[0], groups[0]), (calibration, "calibration", rows[1], groups[1])):
        if part.limit(least).count() < least or part.select(group).distinct().limit(parcels).count() < parcels:
            raise ValueError(f"the {name} sample needs {least} rows of {parcels} groups")
    shared = training.select(group).distinct().join(calibration.select(group).distinct(), group, "left_semi")
    if shared.limit(1).count():
        raise ValueError("training and calibration share groups")


def fit_gbt_conformal(training: DataFrame, calibration: DataFrame, target: str, spec: FeatureSpec, *,
                      alpha: float = 0.1, group: str = "parcel_id", scale: str | None = None,
                      learning_rate: float = 0.06, max_iter: int = 180, max_depth: int = 5,
                      seed: int = 0) -> ConformalModel:
    """Boosted trees on the scaled log target, one conformal score per parcel.

    Trees part numeric features only between bins, so rows of equal bins and categories go through all trees together, and
    only their mean target and number matter to squared errors: each tree is grown on cells, not on all rows again.
    """
    shared_dir(training.sparkSession)
    guard_samples(training, calibration, group)
    unscaled = FeatureSpec(spec.numeric, spec.categorical, False, False, 5 if spec.categorical else 1)
    estimator = GBTRegressor(featuresCol="features", labelCol="_label", predictionCol="_raw",
                             maxIter=max_iter, stepSize=learning_rate, maxDepth=max_depth, seed=seed, maxBins=BINS,
                             weightCol="_many", checkpointInterval=10)
    return _fit_conformal(training, calibration, target, unscaled, estimator, alpha, group, scale, bins=BINS)


VALUATION_FEATURES = FeatureSpec(
    ("log_prior_relative_to_market", "years_since_prior_sale", "sale_quarter"))
EXIT_FEATURES = FeatureSpec(("log_acquisition_price", "acquisition_year", "acquisition_quarter"))


def _common_window(panel: DataFrame, date: str, development: str, holdout: str, starts) -> tuple:
    labelled = splits.geographic_holdout(panel, development, holdout)
    home = labelled.filter("sample = 'development'")
    cutoffs = splits.date_cutoffs(home, date, calibration_start=starts[0], test_start=starts[1])
    split = splits.chronological_split(home, date, cutoffs).filter("kept")
    later = labelled.filter(
        (F.col("sample") == "holdout") & (F.col(date) >= F.lit(cutoffs.test_start)))
    return split, later, cutoffs


def valuation_study(panel: DataFrame, development: str, holdout: str, *, alpha: float = 0.1,
                    spec: FeatureSpec = VALUATION_FEATURES, starts=(None, None),
                    max_iter: int = 180, seed: int = 0) -> tuple[ConformalModel, DataFrame]:
    """Fit on early sales of one market, test later sales of both.

    Returns the model and the scored sales with their ``sample``.
    """
    eligible = panel.filter((F.col("lagged_market_median_price") > 0)
                            & (F.col("rolled_forward_prior_baseline") > 0))
    split, later, _ = _common_window(eligible, "sale_date", development, holdout, starts)
    model = fit_gbt_conformal(
        splits.concat_partitions(split, "training"), splits.concat_partitions(split, "calibration"),
        "sale_price", spec, alpha=alpha, scale="lagged_market_median_price", max_iter=max_iter, seed=seed)
    samples = split.filter("split <> 'training'").withColumn("sample", F.col("split")).drop("split", "kept")
    return model, model.transform(samples.unionByName(later.withColumn("sample", F.lit("holdout_market"))))


def valuation_scores(scored: DataFrame) -> DataFrame:
    """Metrics of the model and of the rolled-forward baseline per sample."""
    model = metrics.weighted_valuation_metrics(scored, ["sample"])
    baseline = metrics.weighted_valuation_metrics(
        scored, ["sample"], prediction="rolled_forward_prior_baseline", lower=None, upper=None)
    blank = {c: F.lit(None).cast("double") for c in model.columns if c not in baseline.columns}
    return model.withColumn("predictor", F.lit("model")).unionByName(
        baseline.withColumns(blank).withColumn("predictor", F.lit("rolled_prior_baseline")))


def sensitivity_rerun(panel: DataFrame, development: str, holdout: str, *, primary: DataFrame | None = None,
                      **options) -> DataFrame:
    """The study again on seasoned sales, and the primary study's predictions rescored on officially
    qualified sales.

    ``primary`` are the scored sales of the primary study, which is fitted here where they are absent.
    """
    if primary is None:
        _, primary = valuation_study(panel, development, holdout, **options)
    seasoned = panel.filter(F.col("years_since_prior_sale") >= panels.SEASONED_YEARS)
    _, scored = valuation_study(seasoned, development, holdout, **options)
    qualified = primary.filter(F.coalesce("qualified", F.lit(False)) & (F.col("sample") == "holdout_market"))
    window = qualified.groupBy("sample").agg(
        F.min("sale_date").alias("window_start"), F.max("sale_date").alias("window_end"))
    rescored = valuation_scores(qualified).join(window, "sample", "left")
    return valuation_scores(scored).withColumns({
        "rule": F.lit("seasoned"), "window_start": F.lit(None).cast("date"),
        "window_end": F.lit(None).cast("date"),
    }).unionByName(rescored.withColumn("rule", F.lit("officially_qualified")))


def exit_study(spells: DataFrame, development: str, holdout: str, *, spec: FeatureSpec = EXIT_FEATURES,
               max_weeks: int = 156, regularization: float = 1.0,
               starts=(None, None)) -> tuple[LogitModel, DataFrame]:
    """Fit hazards on censored early spells of one market, test later spells of both markets."""
    split, later, cutoffs = _common_window(spells, "acquisition_date", development, holdout, starts)
    fitting = survival.admin_censor(
        splits.concat_partitions(split, "training", "calibration"), cutoffs.test_start)
    model = fit_operator_hazard(fitting, spec, max_weeks, regularization)
    test = splits.concat_partitions(split, "out_of_time_test")
    needed = ["parcel_id", "operator", "acquisition_date", *spec.numeric, *spec.categorical, "duration_weeks", "event_observed"]
    samples = [("training", fitting), ("out_of_time_test", test), ("holdout_market", later)]
    parts = [df.select(*needed).withColumn("sample", F.lit(name)) for name, df in samples]
    rows = survival.person_period(parts[0].unionByName(parts[1]).unionByName(parts[2]),
                                  max_periods=max_weeks)
    scored = score_hazard(model, rows)
    rate = scored.filter("sample = 'training'").agg(F.avg("event")).first()[0]
    return model, scored.withColumn("training_rate", F.lit(rate))


def exit_scores(scored: DataFrame) -> DataFrame:
    counted = scored.withColumn("_episode", F.struct("parcel_id", "operator", "acquisition_date"))
    return metrics.hazard_metrics(counted, ["sample"], episode="_episode", parcel="parcel_id").join(metrics.roc_auc(scored, ["sample"]), "sample")
