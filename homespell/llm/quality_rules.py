"""Quality rules, and an isolation forest over the rule statistics.

The base rule rejects texts that are too short or mostly repetition. The forest judges the rest:
trees split at random between the least and greatest value of a random statistic, and a document
that random splits isolate after few steps is anomalous. Its score is ``2 ** (-mean path / c)`` with
``c`` the mean path of an unsuccessful search among as many rows. The cut is calibrated on labelled
rows so that at most ``FALSE_REJECTS`` of those of good quality lie above it. The traits to split on
are calibrated the same way: one after another, that which lets the cut find most bad rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import lowest, map_batches, texts, without_rows
from homespell.llm.text_stats import byte_counts, duplicate_lines, repeated_words, symbols, word_chars, word_ids

#: Least words, and greatest share (in hundredths) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Labelled rows that the forest's trees draw theirs from at most, those of the lowest hash.
SAMPLE_ROWS = 20_000
TREES, SUBSAMPLE, SEED = 100, 256, 7
#: Trees of the trial forests that choose the traits.
TRIAL_TREES = 25
#: Share of good labelled rows that the cut may reject.
FALSE_REJECTS = 0.002

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, row_key long, " + ", ".join(f"{name} long" for name in STATISTICS)


def _measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.zeros((batch.num_rows, len(STATISTICS)), np.int64)
    for at, text in enumerate(texts(batch)):
        if text:
            counts, words = byte_counts(text), text.split()
            rows[at] = (len(words), word_chars(counts), symbols(counts), duplicate_lines(text), repeated_words(word_ids(words)))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *(pa.array(column) for column in rows.T)],
                                      names=["doc_id", "row_key", *STATISTICS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The statistics of each row, and a hash of its text that tells rows of one id apart."""
    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text")), _measure, _SCHEMA)


def _traits(rows: np.ndarray) -> np.ndarray:
    """Scale-free traits of the statistics."""
    n_words, chars, n_symbols, dup_lines, repeated = np.maximum(rows.astype(float), 0).T
    words = np.maximum(n_words, 1)
    return np.stack([np.log1p(n_words), chars / words, n_symbols / np.maximum(chars, 1), np.log1p(dup_lines), repeated / words], axis=1)


def _expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n <= 1, 0.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n)


class IsolationForest:
    """Random split trees as flat arrays: trait, cut, left child (right is next), path at leaves."""

    def __init__(self, rows: np.ndarray, traits: list[int], trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.size = min(subsample, len(rows))
        self.traits = traits
        depth = max(1, int(np.ceil(np.log2(max(self.size, 2)))))
        self.trait, self.cut, self.child, self.path, self.roots = [], [], [], [], []
        for _ in range(trees):
            own = rows[random.choice(len(rows), self.size, replace=False)]
            self.roots.append(self._grow(own, 0, depth, random, self._slot()))
        self.trait, self.child, self.roots = (np.array(x, np.int32) for x in (self.trait, self.child, self.roots))
        self.cut, self.path = np.array(self.cut), np.array(self.path)

    def _slot(self) -> int:
        for column in (self.trait, self.cut, self.child, self.path):
            column.append(-1)
        return len(self.trait) - 1

    def _grow(self, rows: np.ndarray, depth: int, deepest: int, random: np.random.Generator, at: int) -> int:
        low, high = rows.min(axis=0), rows.max(axis=0)
        splittable = [trait for trait in self.traits if high[trait] > low[trait]]
        if depth >= deepest or len(rows) <= 1 or not len(splittable):
            self.path[at] = depth + float(_expected_path(len(rows)))
            return at
        trait = int(random.choice(splittable))
        cut = random.uniform(low[trait], high[trait])
        goes_left = rows[:, trait] <= cut
        left, right = self._slot(), self._slot()
        self.trait[at], self.cut[at], self.child[at] = trait, cut, left
        self._grow(rows[goes_left], depth + 1, deepest, random, left)
        self._grow(rows[~goes_left], depth + 1, deepest, random, right)
        return at

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is more anomalous."""
        total = np.zeros(len(rows))
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                inner = np.flatnonzero(self.child[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = self.child[node] + (rows[inner, self.trait[node]] > self.cut[node])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(float(_expected_path(self.size)), 1e-9))


def calibrated_cut(good: np.ndarray, bad: np.ndarray, false_rejects: float = FALSE_REJECTS) -> float:
    """Score above which rows are rejected.

    At most a share ``false_rejects`` of the good rows lies above it. Without bad rows above it
    nothing is rejected, since the labels then give no reason to.
    """
    if not len(good):
        return np.inf
    ordered = np.sort(good)
    cut = ordered[max(0, len(ordered) - 1 - int(false_rejects * len(ordered)))]
    above = bad[bad > cut]
    # Halfway between the highest good score that is kept and the lowest rejected one above it.
    return float((cut + above.min()) / 2) if len(above) else np.inf


def _chosen(rows: np.ndarray, judged) -> tuple[IsolationForest, float]:
    """Forest on the traits that find most bad rows, and its cut; ``judged`` gives found rows and cut of each of some forests."""
    chosen: list[int] = []
    found = 0
    while len(chosen) < rows.shape[1]:
        rest = [trait for trait in range(rows.shape[1]) if trait not in chosen]
        trials = dict(zip(rest, judged([IsolationForest(rows, [*chosen, trait], TRIAL_TREES) for trait in rest])))
        best = max(rest, key=lambda trait: trials[trait][0])
        if trials[best][0] <= found:
            break
        chosen.append(best)
        found = trials[best][0]
    forest = IsolationForest(rows, chosen or list(range(rows.shape[1])), TREES)
    return forest, judged([forest])[0][1]


def calibrate(rows: np.ndarray, good: np.ndarray) -> tuple[IsolationForest, float]:
    """Forest over all labelled rows, and its cut. ``good`` marks the rows of good quality."""

    def judged(forests: list[IsolationForest]) -> list[tuple[int, float]]:
        scores = [forest.score(rows) for forest in forests]
        cuts = [calibrated_cut(score[good], score[~good]) for score in scores]
        return [(int((score[~good] > cut).sum()), cut) for score, cut in zip(scores, cuts)]

    return _chosen(rows, judged)


def _judged(labelled: DataFrame, n_good: int):
    """``calibrate``'s judgement of forests over a table of labelled rows, which stay where they lie."""
    names = [f"score_{at}" for at in range(len(STATISTICS))]

    def judged(forests: list[IsolationForest]) -> list[tuple[int, float]]:
        def scores(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = _traits(np.stack([batch.column(name).to_numpy() for name in STATISTICS], axis=1))
            return pa.RecordBatch.from_arrays([batch.column("good"), *(pa.array(forest.score(rows)) for forest in forests)],
                                              names=["good", *names[:len(forests)]])

        scored = store.save(map_batches(labelled, scores, "good boolean, " + ", ".join(f"{name} double" for name in names[:len(forests)])), "scores")
        found = []
        for name in names[:len(forests)]:
            # The rejected good rows and the next one: a share of FALSE_REJECTS, of which the least is the cut.
            cut = scored.where("good").select(name).orderBy(F.desc(name)).limit(1 + int(FALSE_REJECTS * n_good)).agg(F.min(name)).first()[0]
            above = scored.where(~F.col("good") & (F.col(name) > cut)).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("least")).first()
            cut = (cut + above["least"]) / 2 if above["n"] else np.inf
            found.append((scored.where(~F.col("good") & (F.col(name) > cut)).count() if above["n"] else 0, float(cut)))
        store.discard(scored)
        return found

    return judged


def fit(statistics: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[IsolationForest | None, float]:
    """Forest and cut from the labelled rows that pass the base rule.

    A tree grows on ``SUBSAMPLE`` rows, as the method has it, which all trees draw from the ``sample_rows`` rows of the lowest
    hash. The traits and the cut are chosen by the scores of all labelled rows.
    """
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = store.save(statistics.where(~_base_failed()).join(quality, "doc_id").withColumn("good", F.col("quality") == 1), "labelled")
    n_good = labelled.where("good").count()
    if not n_good:
        store.discard(labelled)
        return None, np.inf
    sample = lowest(labelled, sample_rows, F.xxhash64("doc_id"), "doc_id", "row_key").select(*STATISTICS).toPandas()
    model = _chosen(_traits(sample[list(STATISTICS)].to_numpy()), _judged(labelled.select("good", *STATISTICS), n_good))
    store.discard(labelled)
    return model


def _base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, row_key``, the statistics, ``base_failed, anomaly, kept`` of each row of ``docs``.

    Needs doc_id and text. Null and empty texts have zero counts and fail the base rule. Labels with
    null fields are ignored; an id labelled both ways counts as bad. Without labels of good
    quality only the base rule decides.
    """
    statistics = store.save(rule_statistics(docs), "rules")
    forest, cut = fit(statistics, labels)

    def verdicts(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.stack([batch.column(name).to_numpy() for name in STATISTICS], axis=1)
        score = forest.score(_traits(rows)) if forest else np.zeros(len(rows))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(score > cut)], names=[*batch.schema.names, "anomaly", "rejected"])

    scored = map_batches(statistics, verdicts, f"{_SCHEMA}, anomaly double, rejected boolean")
    return (scored.withColumn("base_failed", _base_failed())
            .withColumn("kept", ~(F.col("base_failed") | F.col("rejected"))).drop("rejected"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep; all columns stay, repeated rows too."""
    return without_rows(docs, judge(docs, labels).where("not kept"))
