import hashlib
import random
import zlib

import pytest

from homespell.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    """{conv_id: [(role, text), ...]}; turns of one number in the order of their digests."""
    out = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            out.setdefault(conv_id, []).append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(turns)] for c, turns in out.items()}


def shared_heads(said):
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def brute(said):
    nodes = {}
    for c, path in said.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    own = {p: (len(m) - 1) * (len(p[-1][1]) if p else 0) for p, m in nodes.items()}
    kids, saved, leaves = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += own[p]
            leaves[p[:d]] += kids[p] == 0
    out = set()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(said[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "'x' as digest", "2 as chars")


def checked(found, expected):
    rows = [tuple(r) for r in found.select(*NAMES).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(7)
    rows = []
    trunk = [("user" if k % 2 == 0 else "assistant", f"turn {k} é☃") for k in range(30)]
    for c in range(-3, 90):
        # Copies, conversations that part at and inside blocks, and ones that end on a shared path.
        cut = r.choice([0, 1, 2, 3, 4, 5, 8, 9, 12, 30])
        own = trunk[:cut] + [("user", r.choice("abc")) for _ in range(r.choice([0, 0, 1, 2, 5]))]
        rows += [(c, k, role, text) for k, (role, text) in enumerate(own or [("system", "alone")])]
    rows += [(200, 0, "user", "hot"), (200, 1, "assistant", "answer"), (200, 2, "user", "x" * 50_000)]
    rows += [(c, k, role, text) for c in range(201, 260) for k, (role, text) in enumerate([("user", "hot"), ("assistant", "answer"), ("user", "x" * 50)][:1 + c % 3])]
    rows += [(300, None, None, "null turn"), (300, 0, "user", None), (300, None, "user", ""), (301, 1, "a", "b"), (301, 1, "a", "b"), (301, 1, "b", "a"),
             (None, 0, "user", "nobody"), (400, 5, "", ""), (401, 9, None, None), (500, 0, "user", "z")]
    return rows


def test_op11_conversation_trie_against_plain_version(spark, odd_rows):
    checked(prefix_trie.rebuilt_trie(conversations(spark, odd_rows)), brute(shared_heads(ordered(odd_rows))))


def test_trie_of_conversations_as_they_are(spark, odd_rows):
    checked(prefix_trie.conversation_trie(conversations(spark, odd_rows)), brute(ordered(odd_rows)))


def test_long_conversations_and_small_pieces(spark, monkeypatch):
    long = [("user", f"t{k}") for k in range(150)]
    rows = [(c, k, role, text) for c in range(40) for k, (role, text) in enumerate(long[:150 - c // 20] + [("user", "own")] * (c % 3))]
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    checked(prefix_trie.conversation_trie(conversations(spark, rows)), brute(ordered(rows)))


def test_blocks_that_go_on_alike_are_one_cell(spark):
    rows = [(c, k, "user", f"t{k}") for c in range(50) for k in range(40)]
    said = prefix_trie.turns(conversations(spark, rows))
    cells = prefix_trie._cells(prefix_trie._blocks(said), said.select("conv_id").distinct())
    # The root, four turns of the first block, and nine blocks.
    assert cells.count() == 50 * 14


def test_empty_table(spark, odd_rows):
    assert prefix_trie.rebuilt_trie(conversations(spark, odd_rows).limit(0)).count() == 0


def test_no_side_of_a_join_is_collected_by_the_driver(spark):
    """Small files can hold many rows, so that a join planned by their bytes would broadcast them."""
    rows = [(c, t, "user", f"text {c % 7} {t}") for c in range(40) for t in range(9)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    plan = prefix_trie.rebuilt_trie(table)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan
