from homespell.llm import preferences

TURNS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"),
    (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, "system", "alone"), (4, 1, "assistant", None), (4, 1, "assistant", "later"), (7, 0, None, "odd one"), (7, None, "user", ""),
    (8, 0, "user", "a"), (8, 0, "user", "a"), (8, 2, "assistant", "c"), (9, 0, "user", "a"), (9, 1, "user", "b"), (9, 2, "assistant", "c"),
    (None, 0, "user", "nobody"), (10, 0, "user", ""), (11, 0, "user", ""),
]


def brute(turns):
    said = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            turn = preferences.NO_TURN if turn is None else turn
            own = (role or "unknown", text or "")
            said.setdefault(conv, {})
            said[conv][turn] = min(said[conv].get(turn, own), own)
    out = set()
    for pair in {conv >> 1 for conv in said}:
        chosen, rejected = said.get(2 * pair, {}), said.get(2 * pair + 1, {})
        numbers = sorted(chosen.keys() | rejected.keys())
        end = next((n for n in numbers if chosen.get(n) != rejected.get(n)), None)
        common = [n for n in numbers if end is None or n < end]
        for part, conv, own in (("prompt", 2 * pair, chosen), ("chosen", 2 * pair, chosen), ("rejected", 2 * pair + 1, rejected)):
            for n, (role, text) in own.items():
                if (n in common) == (part == "prompt"):
                    out.add((pair, part, n, conv, role, f"<|{role}|>\n{text}<|end|>\n", part != "prompt" and role == "assistant", len(common)))
    return out


def test_against_plain_version(spark):
    conversations = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    rows = preferences.neighbour_preferences(conversations.selectExpr("*", "1 as pair_id", "'x' as part")).collect()
    assert {tuple(r) for r in rows} == brute(TURNS) and len(rows) == len(brute(TURNS))


def test_given_pairs_may_share_conversations(spark):
    conversations = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([("p", 0, 1), ("q", 0, 3), ("r", 5, None), ("s", 1, 1)], "pair_id string, chosen long, rejected long")
    rows = preferences.preference_segments(conversations, pairs).collect()
    parts = {(r.pair_id, r.part, r.turn): (r.trained, r.prompt_turns) for r in rows}
    assert parts[("p", "prompt", 0)] == (False, 1) and parts[("p", "chosen", 1)] == (True, 1) and parts[("p", "rejected", 2)] == (False, 1)
    assert parts[("q", "chosen", 0)] == (False, 0) and parts[("s", "prompt", 2)] == (False, 3)
    assert not any(r.pair_id == "r" for r in rows)


def test_empty_table_and_native_plan(spark):
    conversations = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    assert preferences.neighbour_preferences(conversations.limit(0)).count() == 0
    plan = preferences.neighbour_preferences(conversations)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Window", "CartesianProduct"))


def test_replaced_answers_against_plain_version(spark):
    said = {}
    for conv, turn, role, text in TURNS:
        if conv is not None:
            turn = preferences.NO_TURN if turn is None else turn
            own = (role or "unknown", text or "")
            said.setdefault(conv, {})
            said[conv][turn] = min(said[conv].get(turn, own), own)
    last = {c: max(n for n, own in turns.items() if own[0] == "assistant") for c, turns in said.items() if any(x[0] == "assistant" for x in turns.values())}
    expected = set()
    for c, chosen in said.items():
        other = c ^ 1
        rejected = {n: (c, own) for n, own in chosen.items()}
        if c in last and other in last:
            rejected = {n: own for n, own in rejected.items() if n < last[c]} | {last[c]: (other, said[other][last[other]])}
        end = next((n for n in sorted(chosen.keys() | rejected.keys()) if n not in rejected or n not in chosen or chosen[n] != rejected[n][1]), None)
        prompt = [n for n in chosen if end is None or n < end]
        rows = [("prompt" if n in prompt else "chosen", n, c, own) for n, own in chosen.items()]
        rows += [("rejected", n, source, own) for n, (source, own) in rejected.items() if n not in prompt]
        for part, n, source, (role, text) in rows:
            expected.add((c, part, n, source, role, f"<|{role}|>\n{text}<|end|>\n", part != "prompt" and role == "assistant", len(prompt)))
    conversations = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    found = preferences.replaced_preferences(conversations.selectExpr("*", "1 as pair_id", "'x' as part", "2 as other"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == expected and len(rows) == len(expected)
    assert {r[1] for r in rows} == {"prompt", "chosen", "rejected"}
    plan = found._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Window", "CartesianProduct"))
    assert preferences.replaced_preferences(conversations.limit(0)).count() == 0
