import random

import numpy as np
from pyspark.sql import functions as F

from homespell.llm import graph, near_dedup
from tests.llm.brute import components, shingle_set


def test_matches_all_pairs(docs, odd_texts):
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    source = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    expected = components(source)
    counts = {(doc_id, len(shingle_set(text))) for doc_id, text in source}
    for row in rows:
        if row.doc_id is None:
            assert row.component_id is None and row.kept
            continue
        assert row.component_id == expected[row.doc_id] and row.kept == (row.doc_id == row.component_id)
        assert (row.doc_id, row.n_shingles) in counts


def test_chain_of_near_copies_is_one_component(spark):
    """Ends of the chain are dissimilar; many members share bands with a leader that is not similar."""
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for step in range(40):
        words = list(words)
        words[(7 * step) % 150] = f"n{step}"
        rows.append((100 - step, " ".join(words)))
    shared = " ".join(f"passage{k}" for k in range(60))
    rows += [(1000 + k, shared + " " + " ".join(f"own{k}x{j}" for j in range(60))) for k in range(30)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = components(rows)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) == 31


def test_large_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(r.choice([1, 1, 2, 3])):
            own[r.randrange(80)] = f"z{r.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == components(rows)


def test_keep_first_copies_keeps_columns_and_one_of_each(docs):
    kept = near_dedup.keep_first_copies(docs.withColumn("class", F.lit(1)).withColumn("kept", F.lit("x")))
    assert kept.columns == [*docs.columns, "class", "kept"]
    rows = kept.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    expected = components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    assert sorted(ids) == sorted({i for i, c in expected.items() if i == c})
    assert sum(r.doc_id is None for r in rows) == 1


def test_empty_table(empty_docs):
    assert near_dedup.near_duplicates(empty_docs).count() == 0
    assert near_dedup.keep_first_copies(empty_docs).count() == 0


def test_posterior_bound_keeps_similar_pairs():
    random_ = np.random.default_rng(0)
    left = random_.integers(0, 2**16, (20_000, near_dedup.HASHES), dtype=np.uint16)
    right = np.where(random_.random(left.shape) < 0.75, left, left + 1).astype(np.uint16)
    assert len(near_dedup.surviving(left, right)[0]) == 20_000
    far = np.where(random_.random(left.shape) < 0.3, left, left + 1).astype(np.uint16)
    assert len(near_dedup.surviving(left, far)[0]) < 20


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 500), (700, 600), (600, 700)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {**{k: 0 for k in range(1, 201)}, 700: 600}


def test_bands_of_ids_with_several_texts_do_not_cancel(spark, monkeypatch):
    """Two bands of one id and, twice each, another id: the members differ though ids cancel in pairs."""
    r = random.Random(8)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    def changed(words):
        own = list(words)
        own[len(own) // 2] = f"n{r.randrange(10**9)}"
        return own
    one, two = fresh(120), fresh(120)
    rows = [(3, one), (3, two), (5, changed(one)), (5, changed(one)), (7, changed(two)), (7, changed(two))]
    rows = [(doc_id, " ".join(words)) for doc_id, words in rows]

    def planted(batch):
        import pyarrow as pa
        out = [(hash_, own, mark) for own, mark in zip(batch.column("class").to_pylist(), batch.column("print").to_pylist())
               for hash_ in ((32, 64) if own == 3 else (32,) if own == 5 else (64,))]
        return pa.RecordBatch.from_pydict({name: pa.array(x, pa.int64()) for name, x in zip(("band", "class", "print"), zip(*out))})

    monkeypatch.setattr(near_dedup, "_bands", planted)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in found} == components(rows) == {3: 3, 5: 3, 7: 3}


def test_bit_filter_keeps_every_wanted_row(spark):
    rows = spark.range(200_000).selectExpr("id * 31 - 999 as class", "cast(id as string) as text")
    wanted = rows.where("class % 97 = 0").select("class")
    likely = near_dedup._likely(rows, wanted)
    assert likely.join(wanted, "class").count() == wanted.count()
    # 2,000 of 16 million bits are set, so hardly any other row passes.
    assert likely.count() < wanted.count() * 1.1
    assert near_dedup._likely(rows, wanted.limit(0)).count() == 0
