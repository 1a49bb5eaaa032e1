import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from homespell.llm import line_index, queries
from homespell.llm.cuckoo import CuckooFilter

WHITE = " \t\n\x0b\x0c\r"
ROWS = [
    (1, "A common line\nown line of one"), (2, "a COMMON line \nsecond own line"), (3, "\ta common line\na common line\nshort\nshort"),
    (4, None), (5, ""), (6, "short\nninechars\nninechars"), (7, "ninechars\n\n\n  \nten chars!\nten chars!"), (8, "ten chars!"),
    (8, "ten chars! and more\nanother of eight"), (9, "another of eight\nten chars! and more"), (None, "a common line\nnobody's line here"),
    (10, "nobody's line here\nÉTÉ sur la côte"), (11, "été sur la côte\nÉtÉ sur la côte"),
    (-5, "ééééééééé"), (12, "ééééééééé"),
] + [(100 + k, "hot line of many\n" + "x" * 20_000 + f"\nown {k % 7} of several") for k in range(60)]


def key(line):
    own = line.strip(WHITE)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in own)


def brute(rows):
    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(held.get(key(x), ())) < 2 or len(key(x)) < 10 or min(held[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digested(kept):
    rows = kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key_hi", "'x' as dropped", "2L as n_lines")


@pytest.mark.parametrize("increments", [1, 3])
def test_op13_line_dedup_against_plain_version(spark, increments):
    assert digested(line_index.dedup_lines(frame(spark, ROWS), increments)) == brute(ROWS)


def test_op13_line_dedup_on_odd_texts(spark, tables, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in queries.op13_line_dedup(spark, str(tables)).collect()), key=str) == brute(rows)


def test_removal_gives_the_index_of_what_remains(spark):
    index = line_index.LineIndex(spark, keys_per_shard=20)
    index.insert(frame(spark, ROWS[:9]))
    index.insert(frame(spark, ROWS[9:]))
    gone = [1, 8, 100, 104, 999]
    index.remove(spark.createDataFrame([(x,) for x in [*gone, None, 1]], "doc_id long"))
    left = [row for row in ROWS if row[0] not in gone]
    assert digested(index.keep(frame(spark, left))) == brute(left)
    fresh = line_index.LineIndex(spark)
    fresh.insert(frame(spark, left))
    assert index.keys() == fresh.keys() and index.shards > fresh.shards
    same = lambda x: sorted(tuple(r) for r in x.repeated().collect())
    assert same(index) == same(fresh)
    # Put back, the removed documents are as they were.
    index.insert(frame(spark, [row for row in ROWS if row[0] in gone]))
    assert digested(index.keep(frame(spark, ROWS))) == brute(ROWS)
    index.remove(spark.createDataFrame([(row[0],) for row in ROWS], "doc_id long"))
    assert index.keys() == 0 and index.repeated().count() == 0
    index.discard()


def test_empty_table(spark, empty_docs):
    assert line_index.dedup_lines(empty_docs).count() == 0


def test_hot_line_is_one_row_before_it_moves(spark):
    held = line_index.holders(frame(spark, ROWS))
    plan = held.groupBy("key_hi", "key_lo").agg(F.count(F.lit(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_filter_inserts_and_removes():
    keys = np.random.default_rng(3).integers(0, 2**64, 200_000, dtype=np.uint64)
    own, others = keys[:100_000], keys[100_000:]
    made = CuckooFilter.of(own)
    assert made.holds(own).all() and made.holds(others).mean() < 2e-3
    made.remove(own[:60_000])
    assert made.holds(own[60_000:]).all() and made.holds(own[:60_000]).mean() < 2e-3
    assert int((made.table > 0).sum()) == 40_000
    with pytest.raises(ValueError):
        CuckooFilter.of(own[:100]).remove(others[:50])
    full = CuckooFilter(np.zeros((64, 4), np.uint16))
    assert not full.insert(own[:300]) and not CuckooFilter.of(own[:200]).room_for(300)
    twins = CuckooFilter.of(np.repeat(own[:1], 6))
    twins.remove(np.repeat(own[:1], 6))
    assert not twins.holds(own[:1]).any()
