"""Prefix tries of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns. Conversations are grouped by their successive blocks first: a block
is told by a digest of its turns, a beginning by the fold of its blocks' digests, and one aggregate over
(block number, digest of what comes before) shows whether the members of a group go on alike. Only where they part are
turns looked at: there, the digests of the block's first one, two and more turns give the nodes. Elsewhere the whole block
is one cell, whose inner nodes follow from any member.

Nodes are named by their smallest member and depth, and the nodes of one smallest member are a chain. A node's weight is
counted with that member, so sums over a subtree are sums over members, which combine before they move: a beginning that
very many conversations share is a few rows. The ids that end at a node are hashed in order from a stream of ranges, never gathered.
Only digests and lengths move; texts stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homespell.llm import store
from homespell.llm.text import map_partitions
from homespell.operators.scale import Carried, attach_row, order_groups
from homespell.session import shuffles_dropped

#: Turns of a block.
BLOCK = 4
#: Parts that the cells of a conversation are dealt to.
PARTS = 32
#: Conversations whose first turns come from the one whose id ends them: so many ids have one such, and at most so many turns less one.
SHARE, HEADS = 100, 6
#: Characters of ids that are hashed at a time.
PIECE = 65_536
_NODE = ["depth", "x", "y"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Its file is many times smaller than its rows in the driver's memory, so Spark would take it
    for a short table and collect it there."""
    return df.hint("merge")


def _saved(df: DataFrame, name: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        return store.save(df, name)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, digest, chars`` of each turn, counted from 1 in the order of turn (null first).

    Rows without conv_id are left out; null role and text are empty. Turns of one number are in the order of their digests.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"))
    numbered = order_groups(rows, ["conv_id"], ["turn", "digest"]).carry(position=Carried("one")).result()
    return _saved(numbered.select("conv_id", "position", "digest", "chars"), "turns")


def with_shared_heads(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations and their ids: the first h turns of c come from conversation c - c % 100, where h is the
    crc32 of c modulo 6, and its own turns after its first h follow. ``said``: as ``turns`` gives it."""
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    sizes = said.groupBy("conv_id").agg(F.max("position").alias("size"))
    named = sizes.select("conv_id", heads.alias("heads"), (F.col("conv_id") - F.col("conv_id") % SHARE).alias("base"))
    # A base has at most 5 rows here and 199 conversations that take them.
    first = said.where(F.col("position") < HEADS).select(F.col("conv_id").alias("base"), "position", "digest", "chars")
    shared = _large(named).join(_large(first), "base").where("position <= heads").select("conv_id", "position", "digest", "chars")
    known = sizes.select(F.col("conv_id").alias("base"), "size")
    short = (_large(named).join(_large(known), "base", "left").select("conv_id", (F.col("heads") - F.coalesce("size", F.lit(0))).alias("missing")).where("missing > 0"))
    own = (said.where(F.col("position") > heads).join(_large(short), "conv_id", "left")
           .select("conv_id", (F.col("position") - F.coalesce("missing", F.lit(0))).alias("position"), "digest", "chars"))
    return shared.unionByName(own), sizes.select("conv_id")


def _blocks(said: DataFrame) -> DataFrame:
    """``conv_id, block, x, y, parts, chars`` of each block: the fold of the blocks before it, the digests of its first one, two
    and more turns, and the turns' lengths."""
    number = F.expr(f"(position - 1) div {BLOCK}")
    own = said.groupBy("conv_id", number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", "digest", "chars"))).alias("rows"))
    parts = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda n: F.md5(F.array_join(F.slice("rows.digest", F.lit(1), n), "").cast("binary")))
    own = own.select("conv_id", "block", parts.alias("parts"), F.col("rows.chars").alias("chars"))
    last = own.withColumns(dict(zip(("own_x", "own_y"), _fold("block", F.element_at("parts", -1)))))
    ordered = order_groups(last, ["conv_id"], ["block"]).carry(x=Carried("own_x", "xor", "before"), y=Carried("own_y", "xor", "before"))
    nothing = F.lit(0).cast("long")
    return _saved(ordered.result().select("conv_id", "block", F.coalesce("x", nothing).alias("x"), F.coalesce("y", nothing).alias("y"), "parts", "chars"), "blocks")


def _fold(block: str, part: Column) -> tuple[Column, Column]:
    """128 bits of a block's beginning, told from those of other blocks by its number."""
    return F.xxhash64(block, part), F.xxhash64(part, block, F.lit("second"))


def _cells(blocks: DataFrame, members: DataFrame) -> DataFrame:
    """``conv_id, depth, x, y, from_depth, from_x, from_y, chars`` of the cells on each conversation's path, the root included.

    A cell reaches from one node to another below: a whole block where all that enter it go on alike, else a turn. All
    part at the root's block or are one conversation, so it is refined without asking.
    """
    content = F.element_at("parts", -1)
    later = blocks.where("block > 0")
    parted = (later.groupBy("block", "x", "y").agg(F.min(content).alias("least"), F.max(content).alias("most"))
              .where("least <> most").select("block", "x", "y", F.lit(True).alias("parted")))
    known = (later.join(_large(parted), ["block", "x", "y"], "left").select(*blocks.columns, F.coalesce("parted", F.lit(False)).alias("parted"))
             .unionByName(blocks.where("block = 0").withColumn("parted", F.lit(True))))
    first = (F.col("block") * BLOCK).alias("from_depth")

    def after(part: Column) -> list[Column]:
        own = _fold("block", part)
        return [F.col(name).bitwiseXOR(fold).alias(name) for name, fold in zip(("x", "y"), own)]

    size = F.size("parts")
    whole = known.where("not parted").select(
        "conv_id", (F.col("block") * BLOCK + size).alias("depth"), *after(content), first, F.col("x").alias("from_x"), F.col("y").alias("from_y"),
        F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b).alias("chars"))
    turn = known.where("parted").select("*", F.posexplode("parts").alias("at", "part")).withColumn("upper", F.when(F.col("at") > 0, F.element_at("parts", F.greatest(F.col("at"), F.lit(1)))))
    upper = [F.when(F.col("at") == 0, F.col(name)).otherwise(F.col(name).bitwiseXOR(fold)).alias(f"from_{name}")
             for name, fold in zip(("x", "y"), _fold("block", F.col("upper")))]
    refined = turn.select("conv_id", (F.col("block") * BLOCK + F.col("at") + 1).alias("depth"), *after(F.col("part")),
                          (F.col("block") * BLOCK + F.col("at")).alias("from_depth"), *upper, F.element_at("chars", F.col("at") + 1).alias("chars"))
    nothing = F.lit(0).cast("long")
    root = members.select("conv_id", *[nothing.alias(name) for name in _NODE], F.lit(-1).cast("long").alias("from_depth"),
                          nothing.alias("from_x"), nothing.alias("from_y"), nothing.alias("chars"))
    return _saved(whole.unionByName(refined).unionByName(root), "cells")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted (node, conv_id) rows, joined in pieces."""
    key, first, held, size = None, None, [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*key, first)), pa.array([",".join(held)])], names=[*_NODE, "first", "ids"])

    for batch in batches:
        for *own, conv_id in zip(*(batch.column(name).to_pylist() for name in (*_NODE, "conv_id"))):
            if held and (own != key or size > PIECE):
                yield close()
                held, size = [], 0
            if not held:
                key, first = own, conv_id
            held.append(str(conv_id))
            size += len(held[-1]) + 1
    if held:
        yield close()


def _digested_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's sorted pieces, one piece in memory at a time."""
    key, running = None, None

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([running.hexdigest()])], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(name).to_pylist() for name in (*_NODE, "ids"))):
            if own != key:
                if key is not None:
                    yield close()
                key, running = own, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if key is not None:
        yield close()


def _ends(cells: DataFrame) -> DataFrame:
    """``ends_sha256`` of the nodes at which conversations end."""
    ends = cells.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("node")).select("node.*", "conv_id")
    ranged = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    pieces = map_partitions(ranged, _joined_ids, "depth long, x long, y long, first long, ids string")
    return map_partitions(pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").drop("first"), _digested_ids,
                          "depth long, x long, y long, ends_sha256 string")


def prefix_trie(said: DataFrame, members: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``said`` holds ``conv_id, position, digest, chars`` with positions 1, 2, ... in each conversation, ``members`` all conv_ids once, so
    that conversations without turns end at the root. No members give no rows.
    """
    blocks = _blocks(said)
    cells = _cells(blocks, members)
    same = [F.min(name).alias(name) for name in ("from_depth", "from_x", "from_y", "chars")]
    grouped = cells.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *same)
    nodes = _saved(grouped.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    children = (nodes.where("from_depth >= 0").groupBy(*[F.col(f"from_{name}").alias(name) for name in _NODE])
                .agg(F.count(F.lit(1)).alias("n_children")))
    placed = _saved(
        order_groups(nodes.join(_large(children), _NODE, "left").fillna(0, ["n_children"]), ["conv_id"], ["depth"])
        .carry(below=Carried("weight", over="onward"), chain=Carried("weight", over="all")).result(), "nodes")
    # What a member brings to each node above its own: the weights and the leaf of its chain.
    brought = placed.groupBy("conv_id").agg(F.max("chain").alias("chain"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    # The cells of a long conversation are dealt to parts.
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt = cells.select("conv_id", *_NODE, F.pmod("depth", F.lit(PARTS)).cast("int").alias("part"))
    sums = (dealt.join(_large(brought.where("chain > 0 or leaf > 0").withColumn("part", part)), ["conv_id", "part"])
            .groupBy(*_NODE).agg(F.sum("chain").alias("sum"), F.sum("leaf").alias("n_leaves")))

    uppers = placed.select(*[F.col(name).alias(f"from_{name}") for name in _NODE], F.col("conv_id").alias("upper")).where("from_depth > 0")
    rows = (_large(placed).join(_large(sums), _NODE).join(_large(_ends(cells)), _NODE, "left")
            .join(_large(uppers), ["from_depth", "from_x", "from_y"], "left"))
    # Very many nodes can hang below the root, whose smallest member is one value.
    rows = attach_row(rows, members.agg(F.min("conv_id").alias("least")))
    parent = F.when(F.col("from_depth") == 0, F.col("least")).otherwise(F.col("upper"))
    # Both kinds of cells are read off it.
    shaped = _saved(rows.select("conv_id", "depth", "from_depth", parent.alias("parent"), "n_convs", "n_children", "n_leaves", "chars",
                         (F.col("sum") - F.col("chain") + F.col("below")).alias("saved"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")), "shaped")
    single = shaped.where("depth <= from_depth + 1").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    # The turns of whole blocks, of which those above the last have one child and no ends.
    several = (shaped.where("depth > from_depth + 1").drop("chars").withColumn("block", F.expr(f"from_depth div {BLOCK}"))
               .join(_large(blocks.select("conv_id", "block", "chars")), ["conv_id", "block"]).select("*", F.posexplode("chars").alias("at", "own")))
    before = F.aggregate(F.slice("chars", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, b: a + b)
    last = F.col("at") == F.size("chars") - 1
    inner = several.select(
        "conv_id", (F.col("from_depth") + F.col("at") + 1).alias("depth"), F.when(F.col("at") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * before).alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(_EMPTY).alias("ends_sha256"))
    return single.unionByName(inner)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of ``conversations`` (conv_id, turn, role, text) as they are.

    Null and repeated turns are as in ``turns``; rows without conv_id are left out; an empty table gives no rows; other columns are
    not read.
    """
    said = turns(conversations)
    return prefix_trie(said, said.select("conv_id").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of ``conversations`` with shared heads; see there for the nulls."""
    return prefix_trie(*with_shared_heads(turns(conversations)))


#: The contract in SQL.
TRIE_SQL = r"""
WITH codes AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, u: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS code),
said AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295],
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x))),
        lambda c, b: xor(c // 256, code[xor(c % 256, b) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM said), codes),
rebuilt AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN said s ON s.conv_id = c.base AND pos <= h
    UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN said s ON s.conv_id = c.conv_id AND pos > h),
paths AS (SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS path
    FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d AS depth, path[1:d] AS prefix, path[1:d - 1] AS upper, d = len(path) AS ended,
    CASE WHEN d > 0 THEN length(path[d].text) ELSE 0 END AS chars FROM paths, unnest(range(len(path) + 1)) AS u(d)),
nodes AS (SELECT depth, prefix, min(upper) AS upper, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
    FROM prefixes GROUP BY depth, prefix),
kids AS (SELECT depth - 1 AS depth, upper AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, prefix)),
below AS (SELECT d AS depth, prefix[1:d] AS prefix, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens,
    count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM counted, unnest(range(depth + 1)) AS u(d) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.depth = c.depth AND b.prefix = c.prefix
LEFT JOIN nodes p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.prefix = c.upper
"""
