import tracemalloc

from pyspark.sql import functions as F

from homespell.llm import decontamination


def brute(text, item, threshold=75):
    """Best similarity over windows of as many words as the item, or None."""
    words, own = decontamination.plain_words(text), decontamination.plain_words(item)
    if not words or not own:
        return None
    length, size = min(len(own), len(words)), min(len(own), 5)

    def bag(some):
        size_ = min(size, len(some))
        out = {}
        for k in range(len(some) - size_ + 1):
            key = tuple(some[k:k + size_])
            out[key] = out.get(key, 0) + len(set(key))
        return out

    right, best = bag(own), (-1, 0)
    for start in range(len(words) - length + 1):
        left = bag(words[start:start + length])
        keys = left.keys() | right.keys()
        s = sum(min(left.get(k, 0), right.get(k, 0)) for k in keys) / sum(max(left.get(k, 0), right.get(k, 0)) for k in keys)
        if s > best[0] + 1e-12:
            best = (s, start)
    return best if 100 * best[0] >= threshold - 1e-9 else None


def test_against_all_windows(spark, docs, benchmark):
    found = decontamination.passages(docs.where("length(text) < 5000").withColumn("item_id", F.lit(-1)), benchmark).collect()
    items = {(r.item_id, r.text) for r in benchmark.collect() if r.text}
    expected = set()
    for row in docs.where("length(text) < 5000").collect():
        for item_id, text in items:
            best = brute(row.text.encode(), text.encode())
            if best:
                expected.add((row.doc_id, item_id, best[1], round(best[0], 9)))
    assert {(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in found} == expected
    assert len(expected) >= 5


def test_edited_and_framed_passages(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    edited = passage.replace("word30", "other")
    broken = " ".join(f"word{k}" if k % 6 else "other" for k in range(60))
    rows = [(1, f'Intro, "{passage}." outro'), (2, "x " * 500 + edited + " y" * 500), (3, broken), (4, "nothing at all of it here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage.upper())], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.passages(docs, items).collect()} == {(1, 7), (2, 7)}
    assert {r.doc_id for r in decontamination.without_passages(docs, items).collect()} == {3, 4}


def test_blocks_give_the_same(docs, benchmark, monkeypatch):
    whole = decontamination.passages(docs, benchmark).collect()
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 15)
    assert sorted(map(str, decontamination.passages(docs, benchmark).collect())) == sorted(map(str, whole))


def test_columns_and_empty_tables(docs, empty_docs, benchmark):
    wide = docs.withColumn("similarity", F.lit(1))
    assert decontamination.without_passages(wide, benchmark).columns == wide.columns
    assert decontamination.passages(empty_docs, benchmark).count() == 0
    assert decontamination.passages(docs, benchmark.limit(0)).count() == 0
    assert decontamination.without_passages(docs, benchmark.limit(0)).count() == docs.count()


def test_radius_covers_the_threshold_and_blocks_cover_the_bits():
    assert decontamination.BLOCKS[-1] == decontamination.BITS and len(decontamination.BLOCKS) == decontamination.RADIUS + 2
    assert decontamination.radius(threshold=0.9) < decontamination.RADIUS


def test_windows_far_apart_are_fingerprinted_apart():
    passage = " ".join(f"word{k}" for k in range(50))
    edited = passage.replace("word25", "other")
    text = f"{edited} {' '.join(f'w{k}' for k in range(60_000))} {passage}".encode()
    index = decontamination.ItemIndex([(7, passage.encode())])
    index.matches(text, 75)  # the worker's word cache is filled
    tracemalloc.start()
    found = index.matches(text, 75)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(7, 60_050, 50, 1.0)]
    assert most < 60e6
