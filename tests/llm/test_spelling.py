import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from homespell.llm import queries, spelling, store


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                own = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{own}".encode())
                if h % 31 == 0:
                    own = own[:h % len(own)] + own[h % len(own) + 1:]
                out[own] += len(own) >= 7
                run = ""
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 10 * words[a] else None
    out = set()
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None))
    return out


def stored(spark, words):
    df = spark.createDataFrame(sorted(words.items()), "word string, n long")
    return store.save(df.select("word", "n", F.length("word").alias("chars")), "words")


def test_neighbours(spark):
    """Dense words, words whose beginnings and ends agree, and long words that part late or not at all."""
    r = random.Random(2)
    words = {"".join(r.choices(letters, k=r.randint(7, size))): r.randint(2, 400) for letters, size in [("ab", 13), ("abcdé", 9), ("ÿa", 14)] for _ in range(150)}
    for word in list(words)[::7]:
        at = r.randrange(len(word))
        for other in (word[:at] + word[at + 1:], word[:at] + r.choice("abé") + word[at:], word[:at] + r.choice("ab") + word[at + 1:]):
            if len(other) >= 7:
                words.setdefault(other, r.randint(2, 50))
    long = "variant" * 30
    words |= dict.fromkeys(["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "abaaaaaa", long, long[1:], long[:-1], long[:100] + long[101:], long[:100] + "x" + long[101:]], 2)
    made = ["".join(r.choices("ab", k=r.randint(1, 6))) for _ in range(25)]
    words |= dict.fromkeys([own for x in made for y in made[:4] for own in ("k" * 33 + x + "m" * 20 + y, "n" * 70 + x, x + "o" * 40, x + "p" * 31)], 3)
    rows = spelling.neighbours(stored(spark, words)).collect()
    found = [(r.word, r.near) for r in rows]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert all(r.near_n == words[r.near] for r in rows)


def test_op12_spelling_variants_against_plain_version(spark):
    r = random.Random(9)
    base = ["variant", "spelling", "neighbour", "frontier", "Éclairée", "terminals", "automaton"]
    rows = [(k, " ".join(r.choices(base, weights=[90, 30, 20, 9, 9, 3, 1], k=120)) + r.choice([" Variants", " spellinq", "-frontiér.", " ", " variants2variantss"])) for k in range(60)]
    rows += [(None, "Variant variant neighboür"), (1, None), (2, ""), (3, "x" * 30_000 + " " + "x" * 29_999), (4, "x" * 30_000 + " " + "x" * 29_999), (4, "variantt variantt"), (5, "VARIANTTS\nvarianttt varianttts " * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "1 as n", "2 as chars")
    got = [tuple(x) for x in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(brute_words(rows))
    assert any(row[2] not in (row[0], row[1]) for row in got)


def test_op12_on_odd_texts(spark, tables, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = queries.op12_spelling_variants(spark, str(tables)).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(x) for x in got.collect()} == brute(brute_words(rows))


def test_empty_table(spark, empty_docs):
    assert spelling.variants(empty_docs).count() == 0
