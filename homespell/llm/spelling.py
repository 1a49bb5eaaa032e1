"""Spelling variants: words one edit apart, found by walking a relational trie level by level.

The trie is a table of edges (depth, node, letter, child); nodes are named by hashes of their prefixes. A search
state (word, position, node, edits) is joined with the edges of its node, all states of one depth at a time: a
letter that the word goes on with keeps the edits, any other letter spends the one edit as a replaced, an inserted or
(where the letter after next goes on) a deleted one. With the edit spent, the spelling that the walk must end in is
known and only its letters are followed; states at the end of such a word name a neighbour.

Two bounds keep the frontier small at every size, and neither loses a pair. There is a trie of the words and one of
their mirror images, and edits are allowed only behind the first half of a word: an edit in the first half lies in the second
half of the mirror image. There, few branches are left. And an edge knows how many words lie beyond it and has 256 bits for the
hashes of what they end in, so a state whose rest is certainly not there ends at once; with one word
beyond it, the hash itself decides, and with few the bits end the walk. What is found is then looked up among the words, so
hashes and bits decide nothing alone.

Edges come out of the sorted words: neighbours in that order share all branching prefixes, so each task forms the edges of its
range, and nodes that lie on a boundary are combined afterwards. Edges of nodes with one word are never asked for and not made.
Far below, where only very long words are, an edge goes on to the next branch at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import map_partitions, texts

LEAST_CHARS, LEAST_COUNT = 7, 2
#: One in so many pairs of a document and a run loses a letter.
SLIP = 31
#: How much more frequent than a word its form must be.
FORM_RATIO = 10
#: Depth from which nodes without a branch are left out, so that very long words take no level a letter.
DEEP = 32
#: Words beyond an edge up to which its bits settle a search for now: what they let pass by chance, the words themselves refuse.
FEW = 16
#: 64-bit columns of an edge that hold bits for what the words beyond end in; a power of two.
PARTS = 4
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_CHARS},}}")
#: Seed of the hashes that SQL computes.
_SEED = 42


def _hash(value: bytes) -> int:
    out = xxhash.xxh64_intdigest(value, _SEED)
    return out - 2**64 if out >= 2**63 else out


def words_of(doc_id: int | None, text: bytes | None) -> Counter:
    """Long enough words of a text and how often it holds them; ``doc_id`` decides which runs lose a letter."""
    out: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, count in Counter(_RUN.findall(text.lower().decode()) if text else ()).items():
        code = zlib.crc32(run.encode(), start)
        if code % SLIP == 0:
            at = code % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < LEAST_CHARS:
                continue
        out[run] += count
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n, chars`` of the words of all texts that occur at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                held.update(words_of(doc_id, text))
                if len(held) > HELD_WORDS:
                    yield close()
                    held = Counter()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (map_partitions(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= LEAST_COUNT).select("word", "n", F.length("word").alias("chars")))


def _first_edge(word: str) -> int:
    """Least depth at which a state that may edit can meet this word: half of the shortest word next to it."""
    chars = len(word) - 1
    return (chars - 1) // 2 if word[0] == "f" else chars // 2


class _Edges:
    """Edges of sorted words, each word led by the letter of its trie; those of one node come together.

    ``shared`` counts letters, with the trie's, so a node of depth d is told by d + 1 of them.
    """

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        #: By depth, the shallow edge that the last word lies on: node, letter, child, next depth, words, bits and one hash of ends.
        self.shallow: dict[int, list] = {}
        #: Deep edges that the last word lies on, from the top: letters of the node, words, least letters that they share.
        self.deep: list[list[int]] = []

    def put(self, word: str, shared: int) -> None:
        """Shallow edges of a word that has ``shared`` letters in common with a neighbour."""
        for depth in range(_first_edge(word), min(shared, len(word), DEEP)):
            if depth + 1 == len(word):
                self.rows.append((depth, _hash(word.encode()), "", 0, 0, 1, 0, 0))
            elif depth + 1 < DEEP:
                end = _hash(word[depth + 2:].encode())
                own = self.shallow.get(depth)
                if own is None:
                    own = self.shallow[depth] = [_hash(word[:depth + 1].encode()), word[depth + 1], _hash(word[:depth + 2].encode()), depth + 1, 0, 0, end]
                own[4] += 1
                own[5] |= 1 << (end & (64 * PARTS - 1))
                own[6] = end

    def close(self, word: str, shared: int) -> None:
        """End the edges of ``word`` that the next word, with ``shared`` letters in common, does not lie on."""
        for depth in [d for d in self.shallow if d >= shared - 1]:
            self.rows.append((depth, *self.shallow.pop(depth)))
        below = 0
        while self.deep and self.deep[-1][0] > shared:
            below = self._end(word)
        if self.deep and self.deep[-1][0] == shared:
            self._end(word)
        elif self.deep:
            # The words of this edge have all gone on together so far and part here.
            self._row(word, shared, self.deep[-1][1], below)
            self.deep[-1][2] = shared

    def open(self, word: str, shared: int) -> None:
        """Deep edges of a word after ``close``."""
        for edge in self.deep:
            edge[1] += 1
        if len(word) > max(DEEP, shared):
            self.deep.append([max(DEEP, shared), 1, 0])

    def _end(self, word: str) -> int:
        letters, words, least = self.deep.pop()
        self._row(word, letters, words, least)
        return letters

    def _row(self, word: str, letters: int, words: int, least: int) -> None:
        """The edge that leaves the node of the word's first ``letters``; the next node has ``least``."""
        node = _hash(word[:letters].encode())
        if words > 1:
            self.rows.append((letters - 1, node, word[letters], _hash(word[:least].encode()), least - 1, words, 2**(64 * PARTS) - 1, 0))
        else:
            self.rows.append((letters - 1, node, word[letters:letters + 1], 0, 0, 1, 0, _hash(word[letters + 1:].encode())))

    def batch(self) -> pa.RecordBatch:
        *columns, bits, end = [list(x) for x in zip(*self.rows)]
        self.rows.clear()
        types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
        parts = [np.array([x >> 64 * k & 2**64 - 1 for x in bits], np.uint64).view(np.int64) for k in range(PARTS)]
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(columns, types)), *map(pa.array, parts), pa.array(end, pa.int64())],
                                          names=["depth", "node", "letter", "child", "next", "words", *_ENDS, "end"])


_ENDS = [f"ends_{k}" for k in range(PARTS)]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = _Edges()
    # The first and the last word of a range have neighbours elsewhere: all their shallow edges are made.
    last, before = None, 0
    for batch in batches:
        for word in batch.column("text").to_pylist():
            shared = 0
            if last is not None:
                shared = len(commonprefix((last, word)))
                made.put(last, max(before, shared))
                made.close(last, shared)
            made.open(word, shared)
            last, before = word, len(word) if last is None else shared
        if len(made.rows) > 50_000:
            yield made.batch()
    if last is not None:
        made.put(last, len(last))
        made.close(last, 0)
    if made.rows:
        yield made.batch()


def trie_edges(words: DataFrame) -> DataFrame:
    """``depth, node, letter, child, next, words, ends_k, end`` of both tries: the child's depth is ``next``, and ``words`` counts
    the words beyond. Words that share ``DEEP`` letters come to one task, which sees all nodes below these."""
    both = words.select(F.concat(F.lit("f"), "word").alias("text")).unionByName(words.select(F.concat(F.lit("r"), F.reverse("word")).alias("text")))
    made = map_partitions(both.repartitionByRange(F.substring("text", 1, DEEP)).sortWithinPartitions("text"), _edges,
                          f"depth int, node long, letter string, child long, next int, words long, {', '.join(f'{name} long' for name in _ENDS)}, end long")
    merged = made.groupBy("depth", "node", "letter", "child", "next").agg(
        F.sum("words").alias("words"), *[F.bit_or(name).alias(name) for name in _ENDS], F.max("end").alias("end"))
    # One level is read at a time.
    return store.save(merged.sortWithinPartitions("depth"), "trie-edges")


def _started(words: DataFrame, depth: int) -> DataFrame:
    """States of the words whose search starts at ``depth``: at half of their letters, or above the deep edges."""
    near = words.where(F.col("chars") >= 2 * depth - 1)
    if depth < DEEP - 1:
        near = near.where(F.col("chars") <= 2 * depth + 1)

    def of(side: str, half: str, word: Column) -> DataFrame:
        rows = near.where(F.least(F.expr(half), F.lit(DEEP - 1)) == depth)
        return rows.select(F.lit(side).alias("side"), word.alias("word"), word.alias("target"), F.lit(depth).alias("position"),
                           F.xxhash64(F.concat(F.lit(side), F.substring(word, 1, depth))).alias("node"), F.lit(0).alias("edits"))

    return of("f", "chars div 2", F.col("word")).unionByName(of("r", "chars - chars div 2", F.reverse("word")))


def _advanced(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States one edge on; those with ``found`` have reached a word one edit away."""
    # What a step leaves to find is hashed once a state and not once an edge; with the edit spent, the target only goes on.
    rest = lambda skipped: F.expr(f"xxhash64(substr(target, position + {1 + skipped}))")
    fresh = F.col("edits") == 0
    here = states.withColumns({"own": F.expr("substr(target, position + 1, 1)"), "rest_0": F.when(fresh, rest(0)), "rest_1": rest(1), "rest_2": F.when(fresh, rest(2))})
    met = here.join(edges.drop("depth"), "node").where("edits = 0 or letter = own")

    def step(name: str, condition: Column, skipped: int | None = None) -> Column:
        """``skipped``: letters of the target that the step passes; what is left must lie beyond the edge."""
        if skipped is not None:
            left_over = f"rest_{skipped}"
            part = "case " + " ".join(f"when (({left_over} >> 6) & {PARTS - 1}) = {k} then {own}" for k, own in enumerate(_ENDS)) + " end"
            several = F.expr(f"(shiftrightunsigned({part}, cast(({left_over} & 63) as int)) & 1) = 1")
            condition = condition & F.when(F.col("words") == 1, F.col("end") == F.col(left_over)).otherwise(several)
        return F.when(condition, F.lit(name))

    letter, goes_on = F.col("letter"), F.col("letter") != ""
    same, left = letter == F.col("own"), F.length("target") - F.col("position")
    following = F.expr("substr(target, position + 2, 1)")
    steps = F.array_compact(F.array(
        step("match", fresh & same & goes_on & (F.col("words") > 1)),
        step("follow", ~fresh & same & goes_on, 1),
        step("end", ~fresh & same & ~goes_on),
        step("replace", fresh & ~same & goes_on & (left > 0), 1),
        step("insert", fresh & ~same & goes_on, 0),
        step("delete", fresh & ~same & goes_on & (letter == following), 2),
        step("shorten", fresh & ~goes_on & (left == 1))))
    taken = met.withColumn("step", F.explode(steps))
    head, name = F.expr("substr(target, 1, position)"), F.col("step")
    ending = lambda skipped: F.expr(f"substr(target, position + {1 + skipped})")
    target = (F.when(name == "replace", F.concat(head, "letter", ending(1))).when(name == "insert", F.concat(head, "letter", ending(0)))
              .when(name == "delete", F.concat(head, ending(1))).when(name == "shorten", head).otherwise(F.col("target")))
    found = name.isin("end", "shorten") | ((name != "match") & (F.col("words") <= FEW))
    gone = taken.select("side", "word", target.alias("target"), F.col("next").alias("position"), F.col("child").alias("node"),
                        F.when(name == "match", 0).otherwise(1).alias("edits"), found.alias("found"), (F.col("next") > F.col("position") + 1).alias("_far"))
    # An edge of several letters leads on only where the target has all of them.
    arrives = F.expr("xxhash64(concat(side, substr(target, 1, position))) = node")
    return gone.where(F.col("found") | ~F.col("_far") | arrives).drop("_far")


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n`` of each ordered pair of ``words`` (word, n, chars; a saved table) one edit apart."""
    spark = words.sparkSession
    edges = trie_edges(words)
    ends = edges.agg(F.max("depth"), F.max(F.when(F.col("depth") < DEEP, F.col("depth")))).first()
    levels: list[DataFrame] = []

    def advance(states: DataFrame, some: DataFrame) -> DataFrame:
        levels.append(store.save(_advanced(states, some), "trie-level"))
        return levels[-1].where("not found").drop("found")

    # States above the deep edges go on level by level, those below jump from node to node.
    states = None
    for depth in range(LEAST_CHARS // 2, 0 if ends[0] is None else min(DEEP, (DEEP if ends[0] >= DEEP else ends[1] + 1))):
        started = _started(words, depth)
        states = advance(started if states is None else states.unionByName(started), edges.where(F.col("depth") == depth))
    while states is not None and ends[0] >= DEEP and states.limit(1).count():
        states = advance(states, edges.where(F.col("depth") >= DEEP))
    found = None
    for level in levels:
        ended = level.where("found").select("side", "word", "target")
        found = ended if found is None else found.unionByName(ended)
    if found is None:
        return store.save(spark.createDataFrame([], "word string, near string, near_n long"), "near")
    # A pair whose edit lies in the first half of the word counts where its mirror image is found, others where it is.
    mirrored = F.col("side") == "r"
    turned = found.select("side", *[F.when(mirrored, F.reverse(name)).otherwise(F.col(name)).alias(name) for name in ("word", "target")])
    early = F.expr("substr(word, 1, length(word) div 2) <> substr(target, 1, length(word) div 2)")
    pairs = turned.where(mirrored == early).select("word", F.col("target").alias("near"))
    near = store.save(pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n"), "near")
    store.discard(edges, *levels)
    return near


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of each word with a form, by jumps of doubled length; a form is ten times as frequent, so chains are short."""
    links = store.save(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not links.join(ahead, "root", "left_semi").limit(1).count():
            return links
        further = store.save(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        store.discard(links)
        links = further


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``docs`` (doc_id, text).

    Words are runs of letters, A-Z lowered, some of which lose a letter as the document's id decides; words of at least
    seven code points and two occurrences count. A word's form is its neighbour of largest n (ties: first in code-point
    order) if that is at least ten times the word's n; its root ends the chain of forms and is the word itself where it has
    none. Null and empty texts hold no words; a row without doc_id counts with an empty id; repeated rows count each; an
    empty table gives no rows. Other columns are not read. The number of levels is at most ``DEEP`` and the number of
    branches on the longest path below.
    """
    words = store.save(count_words(docs), "words")
    near = neighbours(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                     F.when(-F.col("best.n") >= FORM_RATIO * F.col("n"), F.col("best")).alias("best"))
    known = store.save(judged.select("word", F.col("best.form").alias("form"), "n", "n_near", (-F.col("best.n")).alias("form_n")), "forms")
    store.discard(near, words)
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The contract in SQL. A run holds code points of one byte and of two, whose lead byte is 195.
VARIANTS_SQL = r"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, u: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS code),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
per_document AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))),
    lambda c, b: xor(c // 256, code[xor(c % 256, b) + 1])), 4294967295) AS h FROM per_document, codes),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM words, unnest(range(length(word))) AS u(i)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (WHERE n = most) AS form
    FROM (SELECT *, max(n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN form END AS form,
    CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
