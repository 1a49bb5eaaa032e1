import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

LETTERS = "the of and re th an er on ti ou in ha is st to en es nt ly bo ca de fu go mi ne pu ra su vi".split()


def invent(random_, words):
    return " ".join("".join(random_.choices(LETTERS, k=random_.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_texts():
    """Texts with every kind of difficulty: null, empty, blank, short, long, copies, near copies, ties."""
    r = random.Random(4)
    base = [invent(r, r.randint(30, 200)) for _ in range(40)]
    near = []
    for text in base[:12]:
        words = text.split()
        for _ in range(3):
            own = list(words)
            own[r.randrange(len(own))] = "changed"
            near.append(" ".join(own))
    long_text = invent(r, 12_000)
    tail = [None, "", " \t\n ", "one", "one two three", "ONE two THREE", "two words", base[0], base[0].upper(), base[1] + "\n" + base[1],
            "mail me at a.b@c.example.com or 10.0.0.1 now", "card 4111 1111 1111 1111 and +1 (415) 555-0100 end", "éà ☃ \x85 ퟿ x" * 5,
            "it's we've 12345 <|endoftext|> a  b \n\n c", "### %%% " * 60, long_text, long_text, "a" * 50_000, "1" * 5_000 + "." + "@" * 300]
    return base + near + tail


@pytest.fixture(scope="session")
def tables(tmp_path_factory, odd_texts):
    """Folder of parquet tables; documents repeat a doc_id and a whole row, and have one null doc_id."""
    folder = Path(tmp_path_factory.mktemp("tables"))
    ids = list(range(len(odd_texts))) + [3, 3, None]
    texts = odd_texts + [odd_texts[3], "another text of the same id " * 4, "a text without id " * 8]
    n = len(ids)
    pq.write_table(pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None, "en"] * (n // 2) + ["en"] * (n % 2)),
        "source": ["src0"] * n, "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}), folder / "documents.parquet")
    known = [i for i in range(len(odd_texts)) if i % 2 == 0]
    pq.write_table(pa.table({"doc_id": pa.array([*known, None, 2, 999_999], pa.int64()), "quality": pa.array([1 if odd_texts[i] and "#" not in odd_texts[i] else 0 for i in known] + [1, None, 1], pa.int32()),
                             "toxic": pa.array([0] * (len(known) + 3), pa.int32())}), folder / "labels.parquet")
    items = [" ".join(odd_texts[5].split()[3:25]), "one two three", None, "", " ".join(odd_texts[8].split()[:20])]
    pq.write_table(pa.table({"item_id": pa.array([*range(len(items)), 4], pa.int64()), "text": [*items, items[4]]}), folder / "benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def docs(spark, tables):
    return spark.read.parquet(str(tables / "documents.parquet"))


@pytest.fixture(scope="session")
def empty_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark, tables):
    return spark.read.parquet(str(tables / "labels.parquet"))


@pytest.fixture(scope="session")
def benchmark(spark, tables):
    return spark.read.parquet(str(tables / "benchmark.parquet"))
