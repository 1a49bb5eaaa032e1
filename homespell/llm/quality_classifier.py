"""Document quality by histogram gradient-boosted trees over text statistics.

Statistics of each whole text are computed once and kept as a small table. Trees are grown level by
level on binned statistics: gradients and hessians of the logistic loss are summed per node, trait and
bin, and each node takes the cut of highest gain. A finished model is a few flat arrays
over all nodes of all trees, which numpy walks for many rows at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import fold_remainder, lowest, map_batches, texts
from homespell.llm.text_stats import byte_counts, repeated_words, symbols, word_chars, word_ids

#: Labelled rows that the trees are fitted on at most: those of the lowest hash of doc_id.
SAMPLE_ROWS = 20_000
#: One fold of so many is held out.
FOLDS = 5
CUT = 0.3
ROUNDS, DEPTH, RATE, BINS, PENALTY, LEAST_HESSIAN = 120, 5, 0.1, 64, 1.0, 5.0

TRAITS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "long_words", "distinct_words", "commonest_word", "repeated_windows",
    "symbols", "upper", "digits", "spaces", "other_bytes", "stops", "commas", "exclamations", "bars", "hyphens", "quotes", "brackets",
    "log_lines", "line_words", "repeated_lines", "byte_entropy",
)


def traits_of(text: bytes | None) -> np.ndarray:
    """Statistics of one text; an empty one has zeros."""
    out = np.zeros(len(TRAITS), np.float32)
    words = text.split() if text else []
    if not words:
        return out
    counts = byte_counts(text)
    ids = word_ids(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    repeats = np.bincount(ids)
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars, n = max(word_chars(counts), 1), len(words)
    share = counts[counts > 0] / len(text)

    def of(characters: bytes) -> float:
        return float(counts[list(characters)].sum()) / chars

    out[:] = (
        np.log1p(chars), np.log1p(n), chars / n, sizes.std(), (sizes > 15).mean(), len(repeats) / n, repeats.max() / n, repeated_words(ids) / n,
        symbols(counts) / chars, counts[65:91].sum() / chars, counts[48:58].sum() / chars, (len(text) - sizes.sum()) / n, counts[0xC0:].sum() / chars,
        of(b"."), of(b",;:"), of(b"!?"), of(b"|"), of(b"-_"), of(b"\"'"), of(b"()[]{}"),
        np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), -(share * np.log2(share)).sum(),
    )
    return out


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = np.stack([traits_of(text) for text in texts(batch)])
    offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(TRAITS))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["doc_id", "traits"])


class BoostedTrees:
    """Flat arrays over all nodes: trait (-1 at leaves), cut, left child (right is next), value."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH):
        self.trait, self.cut, self.child, self.value, self.roots = [], [], [], [], []
        share = (labels.sum() + 1) / (len(labels) + 2)
        self.prior = float(np.log(share / (1 - share)))
        if len(rows) and 0 < labels.sum() < len(labels):
            self._fit(rows, labels, rounds, depth)
        self.trait, self.child, self.roots = (np.array(x, np.int32) for x in (self.trait, self.child, self.roots))
        self.cut, self.value = np.array(self.cut), np.array(self.value)

    def _node(self) -> int:
        for column, empty in ((self.trait, -1), (self.cut, 0.0), (self.child, -1), (self.value, 0.0)):
            column.append(empty)
        return len(self.trait) - 1

    def _fit(self, rows: np.ndarray, labels: np.ndarray, rounds: int, depth: int) -> None:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in rows.T]
        # Bin k holds values above edge k - 1 and up to edge k.
        bins = np.stack([np.searchsorted(edge, column, side="left") for edge, column in zip(edges, rows.T)], axis=1)
        n, width = bins.shape
        flat = bins + np.arange(width) * BINS
        score = np.full(n, self.prior)
        for _ in range(rounds):
            chance = 1 / (1 + np.exp(-score))
            gradient, hessian = chance - labels, chance * (1 - chance)
            root = self._node()
            self.roots.append(root)
            at = np.zeros(n, np.int64)
            nodes = [root]
            leaf_of = np.full(n, root)
            for level in range(depth + 1):
                live = np.flatnonzero(at >= 0)
                if not nodes:
                    break
                total_g = np.bincount(at[live], gradient[live], len(nodes))
                total_h = np.bincount(at[live], hessian[live], len(nodes))
                for k, node in enumerate(nodes):
                    self.value[node] = -RATE * total_g[k] / (total_h[k] + PENALTY)
                if level == depth:
                    break
                keys = (at[live, None] * (width * BINS) + flat[live]).ravel()
                shape = (len(nodes), width, BINS)
                g = np.bincount(keys, np.repeat(gradient[live], width), np.prod(shape)).reshape(shape).cumsum(axis=2)
                h = np.bincount(keys, np.repeat(hessian[live], width), np.prod(shape)).reshape(shape).cumsum(axis=2)
                all_g, all_h = total_g[:, None, None], total_h[:, None, None]
                gain = g**2 / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
                gain[(h < LEAST_HESSIAN) | (all_h - h < LEAST_HESSIAN)] = 0
                best = gain.reshape(len(nodes), -1).argmax(axis=1)
                following, move = [], np.full((len(nodes), 2), -1)
                split_trait, split_bin = best // BINS, best % BINS
                for k, node in enumerate(nodes):
                    if gain[k, split_trait[k], split_bin[k]] <= 1e-6 or split_bin[k] >= len(edges[split_trait[k]]):
                        continue
                    left, right = self._node(), self._node()
                    self.trait[node], self.cut[node], self.child[node] = int(split_trait[k]), float(edges[split_trait[k]][split_bin[k]]), left
                    move[k] = len(following), len(following) + 1
                    following += [left, right]
                own = at[live]
                goes_right = (bins[live, split_trait[own]] > split_bin[own]).astype(int)
                at[live] = move[own, goes_right]
                nodes = following
                stay = live[at[live] >= 0]
                leaf_of[stay] = np.array(nodes, np.int64)[at[stay]] if nodes else leaf_of[stay]
            score += np.array(self.value)[leaf_of]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Chance of label 1."""
        total = np.full(len(rows), self.prior)
        for root in self.roots:
            at = np.full(len(rows), root)
            while True:
                inner = np.flatnonzero(self.child[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = self.child[node] + (rows[inner, self.trait[node]] > self.cut[node])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(described: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> BoostedTrees:
    """Trees from at most ``sample_rows`` labelled rows outside the held-out fold."""
    quality = (labels.where("doc_id is not null and quality is not null").where(fold_remainder("doc_id", FOLDS) != 0)
               .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    labelled = store.save(described.join(quality, "doc_id"), "labelled")
    sample = lowest(labelled, sample_rows, F.xxhash64("doc_id"), "doc_id", "traits").select("quality", "traits").toPandas()
    store.discard(labelled)
    rows = np.array(sample.traits.tolist(), float).reshape(len(sample), len(TRAITS))
    return BoostedTrees(rows, (sample.quality == 1).to_numpy().astype(float))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Needs doc_id and text; nothing else is read. Null and empty texts have zero statistics and get the
    score that the trees give those. A row without doc_id is not held out, and is never learnt from. Labels
    with null fields are ignored, an id labelled both ways counts as 0. Without labels of both kinds all scores
    are the prior.
    """
    text = F.col("text").cast("string")
    described = store.save(map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), _describe,
                                       "doc_id long, traits array<float>"), "traits")
    trees = fit(described, labels)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("traits").values.to_numpy().reshape(-1, len(TRAITS)).astype(float)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(rows))], names=["doc_id", "score"])

    scored = map_batches(described, score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold_remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
