import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from homespell.llm import text, text_stats
from homespell.llm.token_cache import UnitEncoder
from tests.llm.brute import rule_counts

ANY = st.text(st.sampled_from(" \t\n\v\f\r\x1c\x85\xa0aAb1'.,!#éÉß☃x"), max_size=80)


@settings(max_examples=200, deadline=None)
@given(ANY)
def test_words_are_runs_outside_ascii_white_space(value):
    assert [w.decode() for w in value.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", value)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \nab#é"), max_size=200))
def test_counts_against_plain_versions(value):
    raw = value.encode()
    counts = text_stats.byte_counts(raw)
    own = (len(raw.split()), text_stats.word_chars(counts), text_stats.symbols(counts), text_stats.duplicate_lines(raw),
           text_stats.repeated_words(text_stats.word_ids(raw.split())))
    assert own == rule_counts(value)


def test_shingles_of_short_texts_differ_by_length():
    hashes = text.word_hashes()
    seen = {tuple(text.shingles(hashes.of([b"a"] * n)).tolist()) for n in range(5)}
    assert len(seen) == 5
    assert len(text.shingles(hashes.of([b"a", b"b", b"c", b"d", b"e", b"f"]))) == 2


@pytest.fixture(scope="module", params=[("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def pair(request):
    path = public_tokenizers.path(request.param[0])
    return UnitEncoder(path, request.param[1]), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(value=st.text(st.sampled_from(" \t\n ab1'.,!é’ßxstrevemld<|☃\xa0"), max_size=60))
def test_units_give_the_ids_of_the_whole_text(pair, value):
    own, library = pair
    ids, offsets = own.ids([value, None, "", value + " <|endoftext|>"])
    whole = [library.encode(x, add_special_tokens=False).ids for x in (value, "", "", value + " <|endoftext|>")]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == whole


def test_cache_starts_afresh_at_its_bound(pair, monkeypatch):
    from homespell.llm import token_cache

    monkeypatch.setattr(token_cache, "CACHE_UNITS", 10)
    monkeypatch.setattr(token_cache, "CHUNK", 50)
    own, library = pair
    texts = [f"alpha{k} beta {k} gamma" for k in range(40)]
    ids, offsets = own.ids(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert np.all(np.diff(offsets) > 0)


def test_lowest_rows_with_and_without_ties(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("few"))
    expected = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(100).collect()]
    assert [r.id for r in text.lowest(rows, 100, F.xxhash64("id"), "id").collect()] == expected
    assert text.lowest(rows, 4000, F.xxhash64("few"), "id").count() == 4000
    assert text.lowest(rows.limit(0), 5, F.xxhash64("id"), "id").count() == 0
    assert text.lowest(rows, 9000, F.xxhash64("id"), "id").count() == 5000


def test_tasks_give_freed_memory_back(spark, monkeypatch):
    import re
    from pathlib import Path

    import pyarrow as pa

    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def run(batches):
        for batch in batches:
            many = [bytes(2000) for _ in range(150_000)]
            cache.extend(many[::1000])
            yield batch
            del many

    before, cache = [], []
    monkeypatch.setattr(text, "ship", lambda session: None)
    frame = type("Frame", (), {"sparkSession": spark, "mapInArrow": lambda self, task, schema: task})()
    batch = pa.RecordBatch.from_pydict({"id": [1]})
    task = text.map_partitions(frame, run, "id long")
    start = held()
    for _ in task(iter([batch])):
        before.append(held() - start)
    assert held() - start < 60 < before[0]
