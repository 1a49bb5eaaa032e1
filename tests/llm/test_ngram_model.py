import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from homespell.llm import ngram_model
from homespell.llm.elias_fano import Reader, Writer
from tests.llm.brute import lowered


@settings(max_examples=150, deadline=None)
@given(values=st.sets(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=200), others=st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=50))
def test_sequences(values, others):
    own = np.array(sorted(values), np.uint64)
    writer = Writer()
    writer.put_sequence(own)
    writer.put(np.array([7], np.uint16))
    reader = Reader(np.frombuffer(b"".join(writer.chunks()), np.uint8))
    sequence = reader.get_sequence()
    assert reader.get("<u2").tolist() == [7]
    at = {int(v): k for k, v in enumerate(own)}
    asked = np.array([*at, *others], np.uint64)
    assert sequence.find(asked).tolist() == [at.get(int(v), -1) for v in asked]
    if len(own):
        assert (sequence.access(np.arange(len(own))) == own).all()


def test_sequences_are_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 2**32, 100_000, dtype=np.uint64))
    writer = Writer()
    writer.put_sequence(np.unique(values))
    assert sum(map(len, writer.chunks())) * 8 / 100_000 < 2.6 + 16 + 2


def brute(rows):
    """(n_tokens, n_known, N, base, score) of each row."""
    learnt = [lowered(text) + ["</s>"] for doc_id, text in rows if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10]
    one, two, three = Counter(), Counter(), Counter()
    for own in learnt:
        framed = ["<s>", "<s>", *own]
        one.update(own)
        two.update(zip(framed[1:], own))
        three.update(zip(framed, framed[1:], own))
    total, distinct = sum(one.values()), len(one)

    def score(u, v, w):
        p = (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
        base = p
        first = len(learnt) if v == "<s>" else one[v]
        p = 0.6 * two[v, w] / first + 0.4 * p if two[v, w] >= 2 else 0.4 * p
        p = 0.6 * three[u, v, w] / two[u, v] + 0.4 * p if three[u, v, w] >= 2 and v != "<s>" else 0.4 * p
        return math.log10(base), math.log10(p)

    out = []
    for doc_id, text in rows:
        own = lowered(text) + ["</s>"]
        framed = ["<s>", "<s>", *own]
        scores = [score(*x) for x in zip(framed, framed[1:], own)]
        out.append((len(own), sum(one[w] > 0 for w in own), total, sum(x for x, _ in scores), sum(x for _, x in scores)))
    return out


@pytest.mark.parametrize("shard_tokens", [2_000_000, 500])
def test_against_plain_model(docs, monkeypatch, shard_tokens):
    monkeypatch.setattr(ngram_model, "SHARD_TOKENS", shard_tokens)
    found = sorted((tuple(r) for r in ngram_model.score(docs.withColumnRenamed("source", "score")).collect()), key=str)
    source = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(((doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0, *own) for (doc_id, _), own in zip(source, brute(source))), key=str)
    assert len(found) == len(expected)
    for own, want in zip(found, expected):
        assert own[:5] == want[:5]
        assert math.isclose(own[5], want[5], rel_tol=1e-9) and abs(own[6] - want[6]) <= 2e-4 * own[2]


def test_empty_table(empty_docs):
    assert ngram_model.score(empty_docs).count() == 0


def whole_brute(rows):
    """(base, score) of each row where no pair or triple is left out."""
    learnt = [lowered(text) + ["</s>"] for doc_id, text in rows if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10]
    one, two, three, after, after_two = Counter(), Counter(), Counter(), Counter(), Counter()
    for own in learnt:
        framed = ["<s>", *own]
        one.update(own)
        for v, w in zip(framed, own):
            two[v, w] += 1
            after[v] += 1
        for u, v, w in zip(framed, framed[1:], framed[2:]):
            three[u, v, w] += 1
            after_two[u, v] += 1
    total, distinct = sum(one.values()), len(one)
    out = []
    for doc_id, text in rows:
        framed = ["<s>", *lowered(text), "</s>"]
        base = score = 0.0
        for at in range(1, len(framed)):
            v, w = framed[at - 1], framed[at]
            p = (one[w] + 0.1) / (total + 0.1 * (distinct + 1))
            base += math.log10(p)
            if after[v]:
                p = 0.6 * two[v, w] / after[v] + 0.4 * p
            u = framed[at - 2] if at > 1 else None
            if u is not None and after_two[u, v]:
                p = 0.6 * three[u, v, w] / after_two[u, v] + 0.4 * p
            score += math.log10(p)
        out.append((base, score))
    return out


def test_query_leaves_out_no_ngram(spark, tables, docs):
    from homespell.llm.queries import QUERIES

    found = sorted(QUERIES["op5_elias_fano_lm"](spark, str(tables)).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    source = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted(((str(doc_id), len(lowered(text)) + 1, *own) for (doc_id, text), own in zip(source, whole_brute(source))))
    assert len(found) == len(expected)
    for own, (_, n_tokens, base, score) in zip(found, expected):
        assert own.n_tokens == n_tokens and math.isclose(own.base_score, base, rel_tol=1e-9) and abs(own.score - score) <= 2e-4 * n_tokens
    held_out = [r for r in found if r.held_out]
    assert held_out and sum(r.score for r in held_out) > sum(r.base_score for r in held_out)


def test_pairs_without_triples(spark):
    found = ngram_model.score(spark.createDataFrame([(None, ""), (None, ""), (None, "")], "doc_id long, text string"), least_count=1).collect()
    assert len(found) == 3
    for row in found:
        assert math.isclose(row.score, math.log10(0.6 + 0.4 * 3.1 / 3.2), rel_tol=1e-9)


def test_a_node_with_half_of_all_children_is_found_at_once():
    own = np.concatenate([np.arange(500_000, dtype=np.uint64) << np.uint64(40), np.uint64(250_000 << 40) + np.arange(1, 500_001, dtype=np.uint64)])
    own.sort()
    writer = Writer()
    writer.put_sequence(own)
    sequence = Reader(np.frombuffer(b"".join(writer.chunks()), np.uint8)).get_sequence()
    asked = np.random.default_rng(1).integers(0, len(own), 200_000)
    start = time.perf_counter()
    assert (sequence.find(own[asked]) == asked).all()
    assert time.perf_counter() - start < 5
    assert (sequence.find(own[asked] + np.uint64(1 << 39)) == -1).all()


def test_codes_are_off_by_a_cell_at_most():
    random = np.random.default_rng(5)
    values = np.concatenate([1 / random.integers(1, 10**6, 50_000), np.ones(1000)])
    writer = Writer()
    ngram_model.Codes.put(writer, values)
    codes = ngram_model.Codes(Reader(np.frombuffer(b"".join(writer.chunks()), np.uint8)))
    assert codes.codes.width <= 12
    cell = math.log(values.max() / values.min()) / ngram_model.CELLS
    assert np.abs(np.log(codes.get(np.arange(len(values))) / values)).max() <= cell * 1.01
    few = np.array([0.5, 0.25, 0.5, 0.75])
    writer = Writer()
    ngram_model.Codes.put(writer, few)
    assert ngram_model.Codes(Reader(np.frombuffer(b"".join(writer.chunks()), np.uint8))).get(np.arange(4)).tolist() == few.tolist()


def test_blobs_and_wide_slices(monkeypatch):
    keys = np.sort(np.random.default_rng(2).integers(0, 2**63, 1000, dtype=np.uint64))
    small = np.arange(1000, dtype="<u4")
    assert all((a == b).all() for a, b in zip(ngram_model.unpacked(ngram_model.packed([keys, small]), ["<u8", "<u4"]), (keys, small)))
    (a, b), counts = ngram_model._counted([np.array([2, 1, 2, 2]), np.array([5, 9, 5, 1])], np.array([1, 1, 4, 2]))
    assert (a.tolist(), b.tolist(), counts.tolist()) == ([1, 2, 2], [9, 1, 5], [1, 2, 5])
