import corpus_pipeline
from homespell.llm import decontamination, personal_data, quality_rules
from tests.llm.brute import components, rule_counts


def test_stages_decide_on_what_is_left(spark, tables):
    docs = spark.read.parquet(str(tables / "documents.parquet"))
    columns = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tables)).checkpoint()
        left[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns
    for row in left["quality_rules"]:
        n_words, *_, repeated = rule_counts(row.text)
        assert n_words >= 20 and 100 * repeated <= 30 * n_words
    good = [(r.doc_id, r.text) for r in left["quality_rules"]]
    expected = components([x for x in good if x[0] is not None])
    assert sorted(r.doc_id for r in left["minhash_near_dedup"]) == sorted({i for i, c in expected.items() if i == c})
    items = decontamination.ItemIndex([(r.item_id, r.text.encode()) for r in spark.read.parquet(str(tables / "benchmark.parquet")).collect() if r.text])
    clean = [r for r in left["minhash_near_dedup"] if not items.matches(r.text.encode(), 75)]
    assert sorted(r.doc_id for r in left["benchmark_decontamination"]) == sorted(r.doc_id for r in clean)
    assert len(left["pii"]) == len(clean) and not any(personal_data.base_spans(r.text) for r in left["pii"])
    assert {r.doc_id for r in left["best_fit_packing"]} == {r.doc_id for r in left["pii"]}


def test_run_equals_its_stages(spark, tables):
    rows = corpus_pipeline.run(spark, str(tables)).collect()
    assert rows and all(r.offset + r.length <= 2048 for r in rows)


def test_filters_pass_columns_of_any_name(spark, tables, docs, labels, benchmark):
    own = docs.selectExpr("*", "1 as _doc_id", "2 as _row_key", "3 as gone_id", "4 as GONE_KEY", "5 as row_key")
    for stage in (lambda df: quality_rules.keep_good(df, labels), lambda df: decontamination.without_passages(df, benchmark)):
        kept = stage(own)
        assert kept.columns == own.columns
        assert sorted(map(str, kept.select(*docs.columns).collect())) == sorted(map(str, stage(docs).collect()))


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tables / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
