import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from homespell.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(histogram, length, planned):
    used = np.zeros_like(histogram)
    for shape, repeats in planned:
        assert 0 < sum(shape) <= length and repeats > 0
        for part in shape:
            used[part] += repeats
    assert (used[1:] == histogram[1:]).all()
    return sum(repeats for _, repeats in planned)


def test_plan_uses_every_piece_once_and_is_near_the_least():
    random = np.random.default_rng(0)
    for scale, cap in ((3, 256), (50, 256), (5000, 256)):
        histogram = np.zeros(cap + 1, np.int64)
        histogram[1:] = random.poisson(scale * np.exp(-np.arange(cap) / 60))
        sequences = check_plan(histogram, cap, packing.plan(histogram, cap))
        least = -(-(histogram * np.arange(cap + 1)).sum() // cap)
        assert sequences <= 1.02 * least + 2


def test_plan_of_single_lengths():
    for cap, own in ((8, {8: 5}), (8, {5: 4}), (8, {1: 17}), (8, {3: 3, 5: 3}), (8, {}), (8, {7: 2, 2: 1})):
        histogram = np.zeros(cap + 1, np.int64)
        for k, v in own.items():
            histogram[k] = v
        check_plan(histogram, cap, packing.plan(histogram, cap))


def test_fit_approaches_an_exact_solution():
    shapes = packing.patterns(64)
    truth = np.zeros(len(shapes))
    truth[::40] = 100.0
    histogram = np.bincount(shapes.ravel(), np.repeat(truth, 4), 65)
    histogram[0] = 0
    shapes = packing.patterns(64, histogram > 0)
    repeats = packing.fit_repeats(shapes, histogram, 400)
    used = np.bincount(shapes.ravel(), np.repeat(repeats, 4), 65)
    assert (repeats >= 0).all() and np.abs(used - histogram)[1:].sum() < 0.02 * histogram.sum()


def test_patterns_fill_the_sequence():
    shapes = packing.patterns(128)
    assert (shapes.sum(axis=1) == 128).all() and (np.diff(shapes, axis=1) <= 0).all()
    assert len(np.unique(shapes, axis=0)) == len(shapes)


def test_contract(docs):
    length = 64
    rows = packing.pack(docs.withColumnRenamed("n_chars", "length"), PATH, length).collect()
    library = Tokenizer.from_file(PATH)
    expected = []
    for r in docs.collect():
        ids = np.array([*(library.encode(r.text, add_special_tokens=False).ids if r.text else []), 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), length)):
            own = ids[start:start + length]
            expected.append((r.doc_id, piece, start, len(own), zlib.crc32(own.tobytes())))
    assert sorted(map(str, [tuple(r)[:5] for r in rows])) == sorted(map(str, expected))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, size in sorted(own):
            assert offset == end
            end += size
        assert end <= length
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / length + 2


def test_empty_table(empty_docs):
    assert packing.pack(empty_docs, PATH).count() == 0
