import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homespell.llm import quality_classifier, quality_rules
from tests.llm import brute
from tests.llm.brute import rule_counts


def test_rule_statistics(docs, labels):
    judged = quality_rules.judge(docs.withColumn("n_words", F.lit(-1)), labels).collect()
    source = {(r.doc_id, rule_counts(r.text)) for r in docs.collect()}
    assert len(judged) == docs.count()
    for row in judged:
        counts = tuple(row[name] for name in quality_rules.STATISTICS)
        assert (row.doc_id, counts) in source
        assert row.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (row.kept and row.base_failed)


def test_keep_good_keeps_columns(docs, labels):
    kept = quality_rules.keep_good(docs.withColumn("kept", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "kept"]
    good = {(r.doc_id, tuple(r[n] for n in quality_rules.STATISTICS)) for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert {(r.doc_id, rule_counts(r.text)) for r in kept.collect()} == good
    assert sum(r.doc_id is None for r in kept.collect()) == 0  # its words repeat


def test_empty_tables(empty_docs, docs, labels):
    assert quality_rules.judge(empty_docs, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_classifier.classify(empty_docs, labels).count() == 0
    assert quality_classifier.classify(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_forest_isolates_outliers():
    random = np.random.default_rng(0)
    rows = random.random((2100, 3))
    rows[2000:, 1] *= 9
    rows[2000:, 1] += 2
    good = np.arange(2100) < 2000
    forest, cut = quality_rules.calibrate(rows, good)
    score = forest.score(rows)
    assert (score[~good] > cut).mean() > 0.95 and (score[good] > cut).mean() <= quality_rules.FALSE_REJECTS


def test_path_lengths_against_walk():
    rows = np.random.default_rng(1).normal(size=(300, 2))
    forest = quality_rules.IsolationForest(rows, [0, 1], trees=5, subsample=64)

    def walk(at, row):
        while forest.child[at] >= 0:
            at = forest.child[at] + int(row[forest.trait[at]] > forest.cut[at])
        return forest.path[at]

    for row, score in zip(rows[:20], forest.score(rows[:20])):
        mean = np.mean([walk(root, row) for root in forest.roots])
        assert np.isclose(score, 2 ** (-mean / float(quality_rules._expected_path(64))))


def test_trees_learn_an_interaction_and_walk_flat_arrays():
    random = np.random.default_rng(2)
    rows = random.random((3000, 4))
    labels = ((rows[:, 0] > 0.5) ^ (rows[:, 2] > 0.3)).astype(float)
    trees = quality_classifier.BoostedTrees(rows[:2000], labels[:2000])
    assert ((trees.score(rows[2000:]) > 0.5) == labels[2000:]).mean() > 0.97
    at_leaves = trees.child < 0
    assert (trees.trait[at_leaves] == -1).all() and (trees.child[~at_leaves] > 0).all()


def test_classifier_contract_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_classifier.classify(docs.drop("n_chars").withColumn("score", F.lit(1)), labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    judged = [(r.predicted, truth[r.doc_id]) for r in held if r.doc_id in truth]
    assert np.mean([p == t for p, t in judged]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_classifier_ignores_held_out_labels(docs, labels):
    rows = quality_classifier.classify(docs, labels).orderBy("doc_id", "score").collect()
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    assert rows == quality_classifier.classify(docs, turned).orderBy("doc_id", "score").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_op1_quality_classifier_traits_against_plain_counts(odd_texts):
    for text in odd_texts:
        found = dict(zip(quality_classifier.TRAITS, quality_classifier.traits_of(None if text is None else text.encode()).tolist()))
        words = brute.words(text)
        if not words:
            assert not any(found.values())
            continue
        n, chars = len(words), sum(map(len, words))
        sizes = [len(w.encode()) for w in words]
        lines = [x for x in text.split("\n") if brute.words(x)]
        covered = brute.rule_counts(text)[4]
        seen = {w: words.count(w) for w in set(words)} if n < 3000 else {w: sum(x == w for x in words) for w in set(words)}
        share = np.unique(list(text.encode()), return_counts=True)[1] / len(text.encode())
        count = lambda some: sum(c in some for c in text)
        expected = {
            "log_chars": np.log1p(chars), "log_words": np.log1p(n), "word_length": chars / n, "word_length_spread": np.std(sizes),
            "long_words": sum(x > 15 for x in sizes) / n, "distinct_words": len(seen) / n, "commonest_word": max(seen.values()) / n,
            "repeated_windows": covered / n, "symbols": count("#*$%&|<>") / chars, "upper": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
            "digits": count("0123456789") / chars, "spaces": (len(text.encode()) - sum(sizes)) / n, "other_bytes": sum(ord(c) > 127 for c in text) / chars,
            "stops": count(".") / chars, "commas": count(",;:") / chars, "exclamations": count("!?") / chars, "bars": count("|") / chars,
            "hyphens": count("-_") / chars, "quotes": count("\"'") / chars, "brackets": count("()[]{}") / chars, "log_lines": np.log1p(len(lines)),
            "line_words": n / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines), "byte_entropy": -(share * np.log2(share)).sum()}
        assert found == pytest.approx(expected, rel=1e-5, abs=1e-6)


def test_op1_quality_classifier_trees_against_plain_splitting():
    """The first cut has the highest gain of all, each leaf the step of its rows, and the flat walk is the nested one."""
    random = np.random.default_rng(8)
    rows = random.integers(0, 9, (400, 3)).astype(float)
    labels = ((rows[:, 1] > 4) ^ (random.random(400) < 0.1)).astype(float)
    trees = quality_classifier.BoostedTrees(rows, labels, rounds=3, depth=2)
    share = (labels.sum() + 1) / (len(labels) + 2)
    gradient, hessian = share - labels, np.full(400, share * (1 - share))
    worth = lambda some: gradient[some].sum() ** 2 / (hessian[some].sum() + quality_classifier.PENALTY)
    gains = {(t, c): worth(rows[:, t] <= c) + worth(rows[:, t] > c) - worth(np.ones(400, bool)) for t in range(3) for c in range(8)
             if min(hessian[rows[:, t] <= c].sum(), hessian[rows[:, t] > c].sum()) >= quality_classifier.LEAST_HESSIAN}
    best = max(gains, key=gains.get)
    root = trees.roots[0]
    assert trees.trait[root] == best[0] and ((rows[:, best[0]] <= trees.cut[root]) == (rows[:, best[0]] <= best[1])).all()

    def walk(row, node):
        while trees.child[node] >= 0:
            node = trees.child[node] + (row[trees.trait[node]] > trees.cut[node])
        return node

    leaves = np.array([walk(row, root) for row in rows])
    for leaf in set(leaves.tolist()):
        own = leaves == leaf
        assert trees.value[leaf] == pytest.approx(-quality_classifier.RATE * gradient[own].sum() / (hessian[own].sum() + quality_classifier.PENALTY))
    plain = [1 / (1 + np.exp(-(trees.prior + sum(trees.value[walk(row, r)] for r in trees.roots)))) for row in rows]
    assert trees.score(rows) == pytest.approx(plain)
