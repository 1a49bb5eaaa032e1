"""Language-model scores from an Elias-Fano n-gram trie.

The model counts words, pairs and triples of all training documents. A word has the smoothed
probability p1 = (c + 0.1) / (N + 0.1 (V + 1)); pairs and triples that occur at least ``least_count`` times
interpolate theirs with the next shorter: p(w | h) = L c(h w) / c(h) + (1 - L) p(w | shorter h), and a pair or triple that the
model does not hold scores (1 - L) p(w | shorter h), a lower bound, so probabilities never sum to more
than one. With a least count of one, as the registered query asks for, nothing is pruned: a context that was never seen then leaves all
to the shorter estimate, so the probabilities of each context sum to one.

Words are numbered by the order of their 64-bit hashes, so n-grams are told by dense numbers and never by codes that
words might share. The trie is dealt to shards by the hash of a pair. In a shard, level one lists the pairs' first words, level two
the second words of each, and level three the words after each pair. Levels are Elias-Fano sequences: monotone pointers give each
node's range, and its children are stored relative to the node (its number is put before theirs), so that the level is one
monotone sequence in which a successor search from a node's base finds a child. A node's own term of its probability, L c(h w) / c(h), is
quantised: a level's codebook has at most ``CELLS`` values, the means of cells of equal width in the logarithm, so a term is
off by at most the width of a cell. A further set of shards holds the words with their exact counts.

A text is looked through twice to learn and once to score. Each token brings its pair and the word after it, or none at a text's end, to the
pair's shard, where all that a node's terms need comes together: triples add up to their pair, and the dictionary knows the first word's count.
Shards are files in the shared folder that tasks map into memory, so the model may outgrow any heap: a task holds the pages it
looks at, and of opened shards a bounded number. Their names carry the attempt that wrote them and come from the tables of committed
tasks. Lookups sort a slice's distinct n-grams by shard and visit the shards that occur. Counts combine per slice before the
shuffle and travel as compressed differences.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.elias_fano import Packed, Reader, Sequence, Writer
from homespell.llm.text import fold_remainder, lowered_words, map_partitions, mix, texts, word_hashes

FOLDS = 10
#: Occurrences that a pair or triple needs unless the caller says otherwise; weights of the pair and triple estimates.
LEAST_COUNT = 2
PAIR_WEIGHT, TRIPLE_WEIGHT = 0.6, 0.6
SMOOTHING = 0.1
#: Values of a codebook at most: 12 bits.
CELLS = 4096
#: Bytes of text that a task works on at a time.
SLICE_BYTES = 10_000_000
#: Tokens per shard of the trie, and shards of the trie for each of the words.
SHARD_TOKENS = 3_000_000
WORDS_SHARE = 8
#: Tasks that shards are dealt to at most.
MOST_TASKS = 16_384
#: Opened shards that a worker keeps.
OPENED = 64
#: Fixed value: hash of the end of a text.
END = np.uint64(0x5851F42D4C957F2D)
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``SLICE_BYTES`` of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < batch.num_rows:
        before = size[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
        yield batch.slice(low, high - low)
        low = high


def token_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends included, and the offset of each text."""
    hashes = word_hashes()
    parts, sizes = [], []
    for text in texts(batch):
        words = lowered_words(text)
        parts += [hashes.of(words), np.array([END])]
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def shard_of_word(tokens: np.ndarray, shards: int) -> np.ndarray:
    return (((tokens >> _32) * np.uint64(shards)) >> _32).astype(np.int64)


def shard_of_pair(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (((mix(pairs) >> _32) * np.uint64(shards)) >> _32).astype(np.int64)


def _groups(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs and its rows, in their order."""
    order = np.argsort(shard.astype(np.uint16 if len(shard) and shard.max() < 65536 else np.int64), kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(shard[rows[0]]), rows


def _counted(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted by the first column first, and the sums of their counts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [key[order] for key in keys]
    new = np.flatnonzero(np.r_[True, np.any([key[1:] != key[:-1] for key in keys], axis=0)]) if len(order) else np.empty(0, np.int64)
    return [key[new] for key in keys], np.add.reduceat(counts[order], new) if len(new) else np.empty(0, np.int64)


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, the first sorted and told by differences; bytes of one weight lie together."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in (first, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, types: list[str]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    rows, at, out = len(raw) // sum(sizes), 0, []
    for own, size in zip(types, sizes):
        out.append(np.ascontiguousarray(raw[at:at + rows * size].reshape(size, rows).T).view(own).ravel())
        at += rows * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


class Codes:
    """Positive values as codes of a codebook."""

    def __init__(self, reader: Reader):
        self.codes: Packed = reader.get_packed()
        self.book = reader.get("<f8")

    @staticmethod
    def put(writer: Writer, values: np.ndarray) -> None:
        logs = np.log(values)
        low, span = logs.min(initial=0.0), np.ptp(logs) if len(logs) else 0.0
        cell = np.minimum((logs - low) * (CELLS / max(span, 1e-300)), CELLS - 1).astype(np.int64) if span > 0 else np.zeros(len(logs), np.int64)
        taken, code = np.unique(cell, return_inverse=True)
        writer.put_packed(code)
        writer.put(np.bincount(code, weights=values, minlength=len(taken)) / np.maximum(np.bincount(code, minlength=len(taken)), 1))

    def get(self, at: np.ndarray) -> np.ndarray:
        return self.book[self.codes.get(at).astype(np.int64)]


class Words:
    """Numbers and counts of words, dealt to shards by the range of their hashes."""

    def __init__(self, folder: str, files: list[str | None], sizes: list[int], total: int):
        self.folder, self.files, self.total = folder, files, total
        self.bases = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.distinct = int(self.bases[-1])
        #: Numbers after those of the words: the place before a text, the place after it, and words that are not known.
        self.before, self.after, self.unknown = self.distinct, self.distinct + 1, self.distinct + 2
        self.width = (self.distinct + 3).bit_length()
        if self.width > 32:
            raise ValueError("more than 2^32 words")
        self.texts = int(self.find(np.array([END]))[1][0])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and count of each of ``words``: hashes."""
        numbers, counts = np.full(len(words), self.unknown, np.int64), np.zeros(len(words), np.int64)
        for shard, rows in _groups(shard_of_word(words, len(self.files))):
            if self.files[shard] is not None:
                sequence, count = _open_words(self.folder, self.files[shard])
                at = sequence.find(words[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                numbers[rows], counts[rows] = self.bases[shard] + at, count.get(at).astype(np.int64)
        return numbers, counts

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """How often a word, or the place before a text, occurs."""
        out = np.full(len(numbers), self.texts, np.int64)
        own = np.flatnonzero(numbers < self.distinct)
        for shard, rows in _groups(np.searchsorted(self.bases, numbers[own], side="right") - 1):
            _, count = _open_words(self.folder, self.files[shard])
            out[own[rows]] = count.get(numbers[own[rows]] - self.bases[shard]).astype(np.int64)
        return out

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return (counts + SMOOTHING) / (self.total + SMOOTHING * (self.distinct + 1))


class Shard:
    """One shard of the trie."""

    def __init__(self, data: np.ndarray):
        reader = Reader(data)
        self.width = np.uint64(reader.get("<i8")[0])
        self.firsts: Sequence = reader.get_sequence()
        self.seconds: Sequence = reader.get_sequence()
        self.pair_terms = Codes(reader)
        self.thirds: Sequence = reader.get_sequence()
        self.triple_terms = Codes(reader)

    def find_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each pair in the shard, or -1."""
        distinct, at = np.unique(first, return_inverse=True)
        node = self.firsts.find(distinct)[at]
        out = np.full(len(first), -1, np.int64)
        rows = np.flatnonzero(node >= 0)
        out[rows] = self.seconds.find(children(node[rows], second[rows], self.width))
        return out

    def find_triples(self, pair: np.ndarray, third: np.ndarray) -> np.ndarray:
        return self.thirds.find(children(pair, third, self.width))


def children(node: np.ndarray, number: np.ndarray, width: np.uint64) -> np.ndarray:
    """Values relative to a node."""
    return (node.astype(np.uint64) << width) | number.astype(np.uint64)


def shard_chunks(pairs: np.ndarray, thirds: np.ndarray, counts: np.ndarray, words: Words, least_count: int) -> list[bytes]:
    """A shard of sorted, distinct (pair, third) with their counts; a pair has its first word's number in the high half."""
    width = np.uint64(words.width)
    new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.empty(0, np.int64)
    pair_count = np.add.reduceat(counts, new) if len(new) else np.empty(0, np.int64)
    of_pair = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(pairs)]))
    own, kept = pairs[new], pair_count >= least_count
    first, node = np.unique(own[kept] >> _32, return_inverse=True)
    held = (counts >= least_count) & (thirds != words.after)
    number = np.cumsum(kept) - 1
    writer = Writer()
    writer.put(np.array([words.width], np.int64))
    writer.put_sequence(first)
    writer.put_sequence(children(node, own[kept] & _LOW, width))
    Codes.put(writer, PAIR_WEIGHT * pair_count[kept] / words.counts(first.astype(np.int64))[node])
    writer.put_sequence(children(number[of_pair[held]], thirds[held], width))
    Codes.put(writer, TRIPLE_WEIGHT * counts[held] / pair_count[of_pair[held]])
    return writer.chunks()


@functools.lru_cache(maxsize=OPENED)
def _open_words(folder: str, name: str) -> tuple[Sequence, Packed]:
    reader = Reader(store.map_file(folder, name))
    return reader.get_sequence(), reader.get_packed()


@functools.lru_cache(maxsize=OPENED)
def _open_shard(folder: str, name: str) -> Shard:
    return Shard(store.map_file(folder, name))


class Trie:
    """The shards of all pairs."""

    def __init__(self, folder: str, files: list[str | None]):
        self.folder, self.files = folder, files

    def shards(self, number: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """The shards that occur in ``number`` and are not empty, with the rows of each."""
        for shard, rows in _groups(number):
            if self.files[shard] is not None:
                yield _open_shard(self.folder, self.files[shard]), rows


def _training(docs: DataFrame) -> DataFrame:
    """Texts of the rows that the model learns from; rows without doc_id are not held out."""
    return docs.where(F.coalesce(fold_remainder("doc_id", FOLDS) != 0, F.lit(True))).select(F.col("text").cast("string").alias("text"))


def _by_shard(dealt: DataFrame, shards: int, build) -> list:
    """Gather each shard's blobs, from all slices, in one call of ``build(shard, blobs)``, which gives the file's name and two sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        current = None

        def close() -> pa.RecordBatch:
            name, total, distinct = build(current, held)
            return pa.RecordBatch.from_pydict({"shard": pa.array([current], pa.int32()), "file": [name], "total": pa.array([total], pa.int64()), "distinct": pa.array([distinct], pa.int64())})

        for batch in batches:
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist()):
                if shard != current:
                    if held:
                        yield close()
                    current, held = shard, []
                held.append(blob)
        if held:
            yield close()

    tasks = min(shards, MOST_TASKS)
    spread = dealt.repartitionById(tasks, F.col("shard") % tasks).sortWithinPartitions("shard")
    saved = store.save(map_partitions(spread, run, "shard int, file string, total long, distinct long"), "shards")
    found = saved.collect()
    store.discard(saved)
    return found


def _rows(dealt: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard for shard, _ in dealt], pa.int32()), pa.array([blob for _, blob in dealt], pa.binary())], names=["shard", "blob"])


def _put(folder: str, name: str, chunks: list[bytes]) -> str:
    attempt = TaskContext.get().taskAttemptId()
    store.put_file(folder, f"{name}-{attempt}", attempt, chunks)
    return f"{name}-{attempt}"


def _listed(found: list, shards: int, column: str, nothing) -> list:
    out = [nothing] * shards
    for row in found:
        out[row["shard"]] = row[column]
    return out


def build(docs: DataFrame, least_count: int = LEAST_COUNT) -> tuple[Words, Trie]:
    """Count words, pairs and triples of the training rows and write the shards."""
    folder = store.fresh_path(docs.sparkSession, "ngrams")
    training = _training(docs)
    size = training.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(8, -(-size // (6 * SHARD_TOKENS)))
    word_shards = max(4, -(-shards // WORDS_SHARE))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            words, counts = np.unique(token_hashes(batch)[0], return_counts=True)
            yield _rows([(shard, packed([words[rows], counts[rows].astype("<u4")])) for shard, rows in _groups(shard_of_word(words, word_shards))])

    def build_words(shard: int, blobs: list[bytes]) -> tuple[str, int, int]:
        keys, counts = (np.concatenate(c) for c in zip(*(unpacked(blob, ["<u8", "<u4"]) for blob in blobs)))
        (keys,), counts = _counted([keys], counts.astype(np.int64))
        writer = Writer()
        writer.put_sequence(keys)
        writer.put_packed(counts)
        return _put(folder, f"words-{shard:08d}", writer.chunks()), int(counts.sum()), len(keys)

    found = _by_shard(map_partitions(training, count_words, "shard int, blob binary"), word_shards, build_words)
    words = Words(folder, _listed(found, word_shards, "file", None), _listed(found, word_shards, "distinct", 0), sum(row["total"] for row in found))

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            pairs, thirds, counts = slice_triples(*token_hashes(batch), words)
            yield _rows([(shard, packed([pairs[rows], thirds[rows], counts[rows]])) for shard, rows in _groups(shard_of_pair(pairs, shards))])

    def build_shard(shard: int, blobs: list[bytes]) -> tuple[str, int, int]:
        pairs, thirds, counts = (np.concatenate(c) for c in zip(*(unpacked(blob, ["<u8", "<u4", "<u4"]) for blob in blobs)))
        (pairs, thirds), counts = _counted([pairs, thirds], counts.astype(np.int64))
        return _put(folder, f"trie-{shard:08d}", shard_chunks(pairs, thirds, counts, words, least_count)), int(counts.sum()), len(pairs)

    found = _by_shard(map_partitions(training, count_triples, "shard int, blob binary"), shards, build_shard)
    return words, Trie(folder, _listed(found, shards, "file", None))


def slice_triples(tokens: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's pair (with the one before it) and the word after it, once each and sorted, with their counts."""
    distinct, at = np.unique(tokens, return_inverse=True)
    numbers = np.concatenate([words.find(distinct)[0], [words.before, words.after]]).astype(np.uint64)
    before, after = at.copy(), at.copy()
    before[1:], after[:-1] = at[:-1], at[1:]
    before[offsets[:-1]], after[offsets[1:] - 1] = len(distinct), len(distinct) + 1
    # Numbers within the slice have the order of the words' and mostly fit one key.
    bits = np.uint64(int(len(distinct) + 2).bit_length())
    if 3 * int(bits) <= 64:
        key = (before.astype(np.uint64) << np.uint64(2) * bits) | (at.astype(np.uint64) << bits) | after.astype(np.uint64)
        key, counts = np.unique(key, return_counts=True)
        mask = (np.uint64(1) << bits) - np.uint64(1)
        before, at, after = key >> np.uint64(2) * bits, (key >> bits) & mask, key & mask
    else:
        (before, at, after), counts = _counted([before, at, after], np.ones(len(at), np.int64))
    first, second, third = (numbers[own.astype(np.int64)] for own in (before, at, after))
    return first << _32 | second, third.astype("<u4"), counts.astype("<u4")


def score_batch(tokens: np.ndarray, offsets: np.ndarray, words: Words, trie: Trie, whole: bool = False) -> list[np.ndarray]:
    """``n_tokens, n_known, base_score, score`` of each text. ``whole``: nothing was pruned, so contexts never seen are known."""
    distinct, at = np.unique(tokens, return_inverse=True)
    numbers, counts = words.find(distinct)
    short = words.probability(counts)[at]
    number, known, first = numbers[at].astype(np.uint64), counts[at] > 0, offsets[:-1]
    before, known_before = np.empty_like(number), np.empty_like(known)
    before[1:], known_before[1:] = number[:-1], known[:-1]
    before[first], known_before[first] = words.before, words.texts > 0

    keys, back = np.unique(before << _32 | number, return_inverse=True)
    own_shard = shard_of_pair(keys, len(trie.files))
    node, pair_term = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    for shard, rows in trie.shards(own_shard):
        found = shard.find_pairs(keys[rows] >> _32, keys[rows] & _LOW)
        rows, found = rows[found >= 0], found[found >= 0]
        node[rows], pair_term[rows] = found, shard.pair_terms.get(found)
    # A token's triple hangs below the pair of the token before it; a text's first token has none.
    context = np.full(len(tokens), -1, np.int64)
    context[1:] = np.where(node[back[:-1]] >= 0, back[:-1], -1)
    context[first] = -1
    live = np.flatnonzero(context >= 0)
    triple_term = np.zeros(len(tokens))
    for shard, rows in trie.shards(own_shard[context[live]]):
        asked = live[rows]
        found = shard.find_triples(node[context[asked]], number[asked])
        triple_term[asked[found >= 0]] = shard.triple_terms.get(found[found >= 0])
    # Where nothing was pruned, contexts that were never seen leave all to the shorter estimate.
    middle = pair_term[back] + np.where(known_before | (not whole), 1 - PAIR_WEIGHT, 1.0) * short
    score = np.log10(triple_term + np.where((context >= 0) | (not whole), 1 - TRIPLE_WEIGHT, 1.0) * middle)
    return [np.diff(offsets), np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(np.log10(short), first), np.add.reduceat(score, first)]


def score(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row of ``docs``.

    Needs doc_id and text; nothing else is read. A null or empty text is its end alone. Rows without doc_id are learnt
    from and not held out; repeated rows count each. An empty table gives no rows. Pairs and triples that occur less than
    ``least_count`` times are left to the shorter estimate.
    """
    words, trie = build(docs, least_count)
    total, whole = words.total, least_count <= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for full in batches for part in slices(full)):
            n_tokens, n_known, base, own = score_batch(*token_hashes(batch), words, trie, whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(own)],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = map_partitions(rows, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", F.coalesce(fold_remainder("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
