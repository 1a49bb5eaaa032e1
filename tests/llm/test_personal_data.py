import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from homespell.llm import personal_data
from homespell.llm.crf_tagger import CHARACTERS, Tagger
from tests.llm.brute import personal


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123456789.@+-() ab_%é\n"), max_size=60))
def test_base_spans_against_plain_patterns(text):
    assert personal_data.base_spans(text) == personal(text)


def test_gradient_against_differences():
    random = np.random.default_rng(0)
    tagger = Tagger(5)
    codes = random.integers(1, CHARACTERS, (3, 7))
    mask = np.arange(7)[None, :] < np.array([7, 4, 1])[:, None]
    codes[~mask] = 0
    tags = random.integers(0, 5, (3, 7)) * mask
    _, gradient = tagger.loss_and_gradient(codes, mask, tags)
    for name, value in tagger.weights.items():
        for _ in range(4):
            at = tuple(random.integers(0, n) for n in value.shape)
            if name == "embed":
                at = (int(codes[0, 2]), at[1])
            kept, step = value[at], 1e-5
            value[at] = kept + step
            up, _ = tagger.loss_and_gradient(codes, mask, tags)
            value[at] = kept - step
            down, _ = tagger.loss_and_gradient(codes, mask, tags)
            value[at] = kept
            assert np.isclose(gradient[name][at], (up - down) / (2 * step), atol=1e-6), name


def test_best_path_against_all_paths():
    import itertools

    random = np.random.default_rng(1)
    tagger = Tagger(3)
    for name in ("move", "start", "end"):
        tagger.weights[name] = random.normal(size=tagger.weights[name].shape)
    codes, mask = random.integers(1, CHARACTERS, (2, 5)), np.array([[True] * 5, [True] * 3 + [False] * 2])
    scores, _ = tagger.emissions(codes, mask)
    paths, posterior = tagger.decode(codes, mask)
    for row, length in ((0, 5), (1, 3)):
        total = {}
        for path in itertools.product(range(3), repeat=length):
            s = tagger.weights["start"][path[0]] + tagger.weights["end"][path[-1]] + sum(scores[t, row, k] for t, k in enumerate(path))
            total[path] = s + sum(tagger.weights["move"][a, b] for a, b in zip(path, path[1:]))
        best = max(total, key=total.get)
        assert tuple(paths[row, :length]) == best
        whole = np.logaddexp.reduce(list(total.values()))
        assert np.isclose(posterior[row, 0], np.exp(np.logaddexp.reduce([s for p, s in total.items() if p[0] == best[0]]) - whole))


def test_tagger_learns_spans_and_windows_reconcile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = personal_data.train(docs)
    texts = [r.text for r in docs.where(F.col("text").rlike("[0-9@]")).collect()]
    right = total = 0
    for text in texts:
        decoded = []
        starts = personal_data.window_starts(text)
        pieces = [text[s:s + personal_data.WINDOW] for s in starts]
        for start, piece, path, sure in zip(starts, pieces, *tagger.decode(*personal_data.padded(pieces))):
            decoded += personal_data.decoded_spans(path, sure, len(piece), start, len(text))
        base = personal_data.base_spans(text)
        right += len(set(base) & {span for _, span in decoded})
        total += len(base)
    assert total > 20 and right / total > 0.8


def test_windows_hold_every_trigger():
    for length in (1, 47, 96, 97, 143, 144, 145, 1000):
        for at in {0, length // 2, length - 1}:
            text = "a" * at + "7" + "a" * (length - at - 1)
            starts = personal_data.window_starts(text)
            assert any(s <= at < s + personal_data.WINDOW for s in starts) and all(s < max(length, 1) for s in starts)


def test_contract(docs):
    rows = personal_data.personal_spans(docs.withColumn("spans", F.lit("x"))).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for row in rows:
        options = [personal(t) for t in texts[row.doc_id]]
        hashes = {hashlib.sha256(personal_data.spell(o).encode()).hexdigest(): o for o in options}
        base = hashes[row.base_sha256]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(personal_data.spell(base).split(",")) <= set(row.spans.split(","))


def test_redact(docs, empty_docs):
    masked = personal_data.redact(docs.withColumn("n_email", F.lit(5)))
    assert masked.columns == [*docs.columns, "n_email"] and masked.count() == docs.count()
    text = masked.where("text like 'mail me%'").first()
    assert text.text == "mail me at [EMAIL] or [IP] now" and text.n_chars == len(text.text)
    assert masked.where("text like 'card%'").first().text == "card [CARD] and [PHONE] end"
    assert personal_data.redact(empty_docs).count() == 0 and personal_data.personal_spans(empty_docs).count() == 0


def test_added_spans_never_touch_base_spans():
    text = "call 886 555 7964 or +1 (886) 555-7964"
    base = personal_data.base_spans(text)
    added = personal_data.reconcile(text, base, [(0.99, (3, 5, 17)), (0.999, (3, 6, 17)), (0.99, (3, 20, 38)), (0.5, (3, 0, 4))])
    assert set(base) <= set(added) and (3, 6, 17) in added and len(added) == len(base) + 1


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    from homespell.llm import personal_data

    texts = ["mail me at one@example.com"] * 300 + [f"mail me at own{k}@example.com" for k in range(40)]
    seen = []
    monkeypatch.setattr(personal_data.Tagger, "train", lambda self, codes, *rest: seen.append(len(codes)))
    for _ in range(1):
        personal_data.train(spark.createDataFrame([(x,) for x in texts], "text string"), sample_windows=41)
    assert seen == [41]
