"""Near-duplicate documents by MinHash bands with sequential Bayesian verification.

A document is the set of its distinct five-word shingles. Equal sets collapse into one class
before anything else, so exact copies cost one row each and are never paired. Classes that share a
band are candidates. Their signatures are compared batch by batch: after ``n`` compared hashes
with ``m`` agreements, and a uniform prior, the chance that the similarity reaches the threshold is
the binomial tail ``P(Bin(n + 1, t) <= m)``; pairs below ``MISS`` are dropped at once. Survivors are
verified on their full sets.

Only what can still change a component is compared. First every member of a band is paired with the
band's smallest member. Then bands that still hold several components are compared within: members of
different components meet in bounded blocks that carry their sets, each pair in the first band that it
shares, likeliest first, and pairs that earlier links of the block have joined are skipped. A block
gives only links that join something, so the result grows with the members and not with their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from homespell.llm import graph, store
from homespell.llm.text import lowered_words, map_batches, map_partitions, mix, ragged, shingles, texts, word_hashes

#: 32 bands of 4: a pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared between two looks at the posterior.
BATCH = 32
#: Posterior chance of reaching the threshold below which a pair is dropped.
MISS = 1e-5
#: Similarity in hundredths.
THRESHOLD = 75
#: Parts that a band's rows are dealt to.
SALT = 8
#: Bits of the filter that keeps texts outside all shared bands from being shuffled: 2 MB at every size. Where it fills up,
#: more texts go on to the exact join.
FILTER_BITS, BUCKET_BITS = 1 << 24, 1 << 15
#: Members of a band that one task compares with as many others at a time.
BLOCK = 256

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
_FACTORS, _SHIFTS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


def signature(elements: np.ndarray) -> np.ndarray:
    """Sixteen bits of each of the ``HASHES`` minima over a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(elements), 4096):
        np.minimum(low, (elements[start:start + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=low)
    return (low >> np.uint64(40)).astype(np.uint16)


def least_matches(compared: int, threshold: float = THRESHOLD / 100, miss: float = MISS) -> int:
    """Fewest agreements among ``compared`` hashes that keep the posterior at ``miss`` or above."""
    tail = 0.0
    for m in range(compared + 1):
        tail += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= miss:
            return m
    return compared + 1


def surviving(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the signature pairs that are never pruned, and their agreements."""
    at = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for end in range(BATCH, HASHES + 1, BATCH):
        matches = matches + (left[at, end - BATCH:end] == right[at, end - BATCH:end]).sum(axis=1, dtype=np.int32)
        stay = matches >= least_matches(end)
        at, matches = at[stay], matches[stay]
    return at, matches


def digest(elements: np.ndarray) -> bytes | None:
    """128 bits that stand for a non-empty set of distinct elements, in any order."""
    if not len(elements):
        return None
    return np.array([elements.sum(), np.bitwise_xor.reduce(mix(elements))], np.uint64).tobytes()


def _describe(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes = word_hashes()
    counts, digests, signatures = [], [], []
    for text in texts(batch):
        elements = np.unique(shingles(hashes.of(lowered_words(text))))
        counts.append(len(elements))
        digests.append(digest(elements))
        signatures.append(signature(elements).tobytes() if len(elements) else None)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
        names=["doc_id", "n_shingles", "digest", "signature"])


def describe(docs: DataFrame) -> DataFrame:
    """Set size, digest of the set and signature of each row; the text stays where it is."""
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _describe,
                       "doc_id long, n_shingles long, digest binary, signature binary")


def _bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each band of each class's text, with the text's print. The lowest five bits of a band's key are its position."""
    signatures = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(-1, BANDS)
    keys = (mix(signatures) << np.uint64(5)) | np.arange(BANDS, dtype=np.uint64)
    row = np.repeat(np.arange(batch.num_rows), BANDS)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), batch.column("class").take(pa.array(row)),
                                       batch.column("print").take(pa.array(row))], names=["band", "class", "print"])


def _compare_pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    def stack(name: str) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, HASHES)

    at, _ = surviving(stack("signature_a"), stack("signature_b"))
    return batch.select(["a", "b", "digest_a", "digest_b"]).take(pa.array(at))


def _common(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum())


def _block_links(threshold: int):
    """Links between different components inside each (band, part) run of sorted rows."""

    def of_run(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(rows).combine_chunks()
        component = table.column("component").to_numpy().tolist()
        side, band_at = table.column("side").to_numpy(), table.column("band")[0].as_py() % BANDS
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
        lists = table.column("elements").chunk(0)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        number = np.unique(component, return_inverse=True)[1]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for start in range(0, len(left), 64):
            i, j = (x.ravel() for x in np.meshgrid(left[start:start + 64], right, indexing="ij"))
            apart = number[i] != number[j]
            i, j = i[apart], j[apart]
            at, matches = surviving(signatures[i], signatures[j])
            i, j = i[at], j[at]
            shared = (signatures[i] == signatures[j]).reshape(-1, BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band_at
            found.append(np.stack([matches[first], i[first], j[first]]))
        pairs = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
        parent = list(range(number.max() + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        joined_a, joined_b = [], []
        for at in np.argsort(-pairs[0], kind="stable").tolist():
            i, j = int(pairs[1, at]), int(pairs[2, at])
            a, b = root(number[i]), root(number[j])
            if a == b:
                continue
            one, two = values[offsets[i]:offsets[i + 1]], values[offsets[j]:offsets[j + 1]]
            common = _common(one, two)
            if 100 * common >= threshold * (len(one) + len(two) - common):
                parent[max(a, b)] = min(a, b)
                joined_a.append(component[i])
                joined_b.append(component[j])
        if not joined_a:
            return None
        return pa.RecordBatch.from_arrays([pa.array(joined_a, pa.int64()), pa.array(joined_b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in ("band", "part_a", "part_b")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:]):
                now = tuple(keys[start].tolist())
                if key is not None and now != key:
                    if (out := of_run(held)) is not None:
                        yield out
                    held = []
                key = now
                held.append(batch.slice(start, end - start))
        if held and (out := of_run(held)) is not None:
            yield out

    return run


def _with_band(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (band, class) with the columns of ``facts``, which has one row a band: a band's rows are dealt to ``SALT`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("class"), F.lit(SALT)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(repeated, ["band", "_salt"]).drop("_salt")


def _likely(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose class is among ``classes``, and some others that share a bit with one; bits merge in any order."""
    place = F.pmod(F.xxhash64("class"), F.lit(FILTER_BITS))
    bits = classes.groupBy((place / BUCKET_BITS).cast("int").alias("_bucket")).agg(F.bitmap_construct_agg(place % BUCKET_BITS).alias("_bits"))
    at = place % BUCKET_BITS
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    known = rows.withColumn("_bucket", (place / BUCKET_BITS).cast("int")).join(F.broadcast(bits), "_bucket")
    return known.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1).select(*rows.columns)


def _split_bands(members: DataFrame) -> DataFrame:
    """Rows of the bands that hold several components, dealt into bounded parts.

    The component with most members in a band is its core; its members need not meet each other.
    Other members (the fringe) form blocks of about ``BLOCK`` rows; every fringe block meets every
    block of the band. A row goes to a part as side 0 (fringe block) or side 1 (the block it meets);
    a fringe block meets itself through both sides.
    """
    per_component = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = (per_component.groupBy("band")
             .agg(F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("n", "component")).alias("core"),
                  F.max("n").alias("core_n"), F.sum("n").alias("band_n"))
             .where("components > 1")
             .select("band", "core", F.ceil(F.col("core_n") / BLOCK).cast("int").alias("core_blocks"),
                     F.ceil((F.col("band_n") - F.col("core_n")) / BLOCK).cast("int").alias("fringe_blocks")))
    placed = (_with_band(members, store.save(shape, "shapes"))
              .withColumn("fringe", F.col("component") != F.col("core"))
              .withColumn("block", F.pmod(F.xxhash64("class"), F.when(F.col("fringe"), F.col("fringe_blocks")).otherwise(F.col("core_blocks"))).cast("int")))
    fringe_parts = F.sequence(F.lit(0), F.col("fringe_blocks") - 1)
    # Blocks are numbered fringe first, then core. A part is (fringe block, other block >= it).
    as_left = F.when(F.col("fringe"), F.transform(
        F.sequence(F.col("block"), F.col("fringe_blocks") + F.col("core_blocks") - 1),
        lambda other: F.struct(F.col("block").alias("part_a"), other.alias("part_b"), F.lit(0).alias("side")))).otherwise(
        F.array().cast("array<struct<part_a:int,part_b:int,side:int>>"))
    own = F.when(F.col("fringe"), F.col("block")).otherwise(F.col("fringe_blocks") + F.col("block"))
    as_right = F.transform(F.filter(fringe_parts, lambda left: left <= own),
                           lambda left: F.struct(left.alias("part_a"), own.alias("part_b"), F.lit(1).alias("side")))
    return (placed.withColumn("part", F.explode(F.concat(as_left, as_right)))
            .select("band", F.col("part.part_a"), F.col("part.part_b"), F.col("part.side"), "class", "component"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    side = lambda s: sets.select(F.col("digest").alias(f"digest_{s}"), F.col("elements").alias(f"elements_{s}"))
    common = F.size(F.array_intersect("elements_a", "elements_b")).cast("long")
    union = F.size("elements_a") + F.size("elements_b") - common
    return (pairs.join(side("a"), "digest_a").join(side("b"), "digest_b")
            .where(100 * common >= threshold * union).select("a", "b"))


def _element_lists(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes = word_hashes()
    lists = [np.unique(shingles(hashes.of(lowered_words(text)))) for text in texts(batch)]
    return pa.RecordBatch.from_arrays(
        [pa.array([digest(x) for x in lists], pa.binary()), ragged([x.view(np.int64) for x in lists], np.int64)], names=["digest", "elements"])


def _apart(members: DataFrame, forest: DataFrame, held: DataFrame, threshold: int) -> DataFrame:
    """Links between components that bands still hold apart. ``held``: class, signature and elements."""
    component = forest.select(F.col("node").alias("class"), "component")
    labelled = (members.where("n > 2").join(component, "class", "left")
                .select("band", "class", F.coalesce("component", "class").alias("component")))
    parts = (_split_bands(labelled).join(held, "class")
             .repartition("band", "part_a", "part_b").sortWithinPartitions("band", "part_a", "part_b"))
    return map_partitions(parts, _block_links(threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (needs doc_id and text).

    Null or wordless texts have no shingles and are linked with nothing; a text of fewer than five
    words is one shingle. A row without doc_id is linked with nothing, has no component and is
    kept. Rows that repeat a doc_id are one document, which has the links of all of them. Other
    columns are not read. ``threshold`` is in hundredths; below 75 the bands miss more pairs than
    the module says.
    """
    described = store.save(describe(docs), "described")
    named = described.where("doc_id is not null and n_shingles > 0")
    classes = store.save(named.groupBy("digest").agg(F.min("doc_id").alias("class"), F.first("signature").alias("signature")), "classes")
    rows = store.save(described.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
                      .join(classes.select("digest", "class"), "digest", "left").select("doc_id", "n_shingles", "class"), "rows")
    store.discard(described)

    # Bands with the same members (a tight group shares most of its bands) are compared once, at the
    # first of them, so the first band that a pair shares is always among those kept. Members are told by
    # the digests of their texts, which are distinct: an id that repeats with other texts would cancel itself.
    bands = map_batches(classes.select("class", "signature", F.xxhash64("digest").alias("print")), _bands, "band long, class long, print long")
    shared = (bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"), F.bit_xor("print").alias("print"))
              .where("n > 1")
              .groupBy("n", "least", "print").agg(F.min(F.struct(F.pmod("band", F.lit(BANDS)), "band")).alias("first")))
    members = store.save(_with_band(bands.drop("print"), store.save(shared.select("first.band", "n", "least"), "bands")), "members")

    reps = docs.select(F.col("doc_id").cast("long").alias("class"), F.col("text").cast("string").alias("text"))
    # Rows that repeat an id give the sets of all their texts, so the digest is taken from the set.
    wanted = store.save(members.select("class").distinct(), "wanted")
    sets = store.save(map_batches(_likely(reps, wanted).join(wanted, "class").select("text"), _element_lists, "digest binary, elements array<bigint>")
                      .where("digest is not null").groupBy("digest").agg(F.first("elements").alias("elements")), "sets")

    side = lambda s: classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("class", "digest", "signature")])
    leaders = (members.where("class <> least").select(F.col("class").alias("class_a"), F.col("least").alias("class_b")).distinct()
               .join(side("a"), "class_a").join(side("b"), "class_b"))
    pairs = map_batches(leaders.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "digest_a", "digest_b", "signature_a", "signature_b"), _compare_pairs,
                        "a long, b long, digest_a binary, digest_b binary")
    several = (rows.where("class is not null").groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("most")).where("b <> most"))
    same_id = rows.join(several, "doc_id").select(F.col("class").alias("a"), "b")
    forest = graph.components(_verified(pairs, sets, threshold).unionByName(same_id))

    found = store.save(_apart(members, forest, sets.join(classes, "digest").select("class", "signature", "elements"), threshold), "links")
    if found.limit(1).count():
        forest = graph.components(found.unionByName(forest.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    store.discard(found)
    store.discard(members, sets, classes)

    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class", "doc_id"))
    return (rows.join(forest.select(F.col("node").alias("class"), "component"), "class", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"),
                    F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the later documents of each group; all columns stay.

    Of rows that repeat the doc_id of a kept document one row stays. Rows without doc_id stay.
    """
    dropped = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    alone = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # Only ids that occur more than once are sorted out; the others never move again.
    single = alone.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    several = alone.join(repeated.select("doc_id"), "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return single.unionByName(several)
