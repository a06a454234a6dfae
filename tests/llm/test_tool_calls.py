import json
import random

import pytest
from pliegos.llm import queries, tool_calls

CALLS = "conversation long, call_id string, position long, name string, arguments string, depends_on array<string>"
RESULTS = "conversation long, call_id string, position long, content string"
SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer", "minimum": 0}}}}


def linked(spark, calls, results):
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return sorted(rows, key=lambda r: (r.conversation, r.place))


def test_every_status(spark):
    calls = [
        (1, "a", 0, "f", '{"x": 1}', None),
        (1, "b", 1, "f", '{"x":-1,"y":2}', ["a", "zzz"]),
        (1, "c", 2, "g", "{}", []),
        (1, "d", 3, "f", "{broken", None),
        (1, "e", 4, "f", None, None),
        (None, "x", 0, "f", "{}", None),
        (1, None, 0, "f", "{}", None),
        (1, "a", 7, "f", '{"x": 9}', None),
    ]
    results = [(1, "a", 5, 'say "é"\n'), (1, "a", 9, "later"), (1, "q", 6, "alone"), (None, "a", 0, "x")]
    rows = {r.call_id: r for r in linked(spark, calls, results)}
    assert {k: r.status for k, r in rows.items()} == {"a": "linked", "b": "unanswered", "c": "unanswered", "d": "unanswered", "e": "unanswered", "q": "orphan"}
    assert json.loads(rows["a"].message) == {"arguments": {"x": 1}, "id": "a", "name": "f", "result": 'say "é"\n'}
    assert rows["a"].message == tool_calls.canonical(json.loads(rows["a"].message))
    assert (rows["a"].n_calls, rows["a"].n_results, rows["a"].valid) == (2, 2, True)
    assert rows["b"].errors == ["$.y: not allowed", "$.x: minimum is 0"] and rows["b"].missing_dependencies == 1
    assert not rows["c"].valid and not rows["d"].valid and not rows["e"].valid and not rows["q"].valid
    assert sorted(r.place for r in rows.values()) == list(range(6))


def test_order_is_topological_and_cycles_come_last(spark):
    r = random.Random(6)
    calls, needs = [], {}
    for conversation in range(6):
        n = 12
        rank = list(range(n))
        r.shuffle(rank)
        for k in range(n):
            before = [str(j) for j in range(n) if rank[j] < rank[k] and r.random() < 0.2]
            if conversation == 5 and k in (0, 1):
                before = [str(1 - k)]
            needs[conversation, str(k)] = before
            calls.append((conversation, str(k), k, "f", '{"x":1}', before))
    rows = linked(spark, calls, [])
    place = {(x.conversation, x.call_id): x.place for x in rows}
    cyclic = {(x.conversation, x.call_id) for x in rows if x.cyclic}
    for key, before in needs.items():
        for b in before:
            if key not in cyclic:
                assert place[key[0], b] < place[key]
    assert {(5, "0"), (5, "1")} <= cyclic and all(c == 5 for c, _ in cyclic)
    assert min(place[k] for k in cyclic) == 12 - len(cyclic)


def test_calls_in_order_keep_their_positions(spark):
    calls = [(1, f"{k:03d}", k, "f", '{"x":1}', [f"{k - 1:03d}"] if k else None) for k in range(200)]
    assert [r.call_id for r in linked(spark, calls, [])] == [f"{k:03d}" for k in range(200)]


def test_whole_table_links_every_turn(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    calls, results = tool_calls.from_turns(turns)
    rows = tool_calls.link(calls, results, {"reply": tool_calls.REPLY_SCHEMA}).collect()
    said = [(t.conv_id, t.turn, t.role) for t in turns.collect()]
    others = {(str(c), f"{c}:{n}") for c, n, role in said if role not in ("user", "assistant")}
    asked = {(str(c), f"{c}:{n}") for c, n, role in said if role == "user"}
    answered = {(str(c), f"{c}:{n - 1}") for c, n, role in said if role == "assistant"}
    assert {(str(r.conversation), r.call_id) for r in rows} == asked | answered | others
    assert len(rows) + len(asked & answered) == len(said) and {r.status for r in rows if (str(r.conversation), r.call_id) in others} <= {"orphan"}
    assert {(str(r.conversation), r.call_id) for r in rows if r.status == "linked"} == asked & answered


def plain_order(positions, needs):
    """The order by its definition: the closure of each call, by repeated relaxation over all edges."""
    closure = {c: set(needs.get(c, ())) for c in positions}
    grown = True
    while grown:
        grown = False
        for c in closure:
            more = set().union(*(closure[d] for d in closure[c])) - closure[c] if closure[c] else set()
            if more:
                closure[c] |= more
                grown = True
    on_cycle = {c for c in closure if c in closure[c]}
    cyclic = {c for c in closure if c in on_cycle or closure[c] & on_cycle}
    state = {c: (p, 0) for c, p in positions.items()}
    for _ in positions:
        for c in positions:
            for d in needs.get(c, ()):
                if c not in cyclic:
                    state[c] = max(state[c], (state[d][0], state[d][1] + 1))
    key = {c: (c in cyclic, *((positions[c], 0) if c in cyclic else state[c]), positions[c], c) for c in positions}
    return sorted(positions, key=key.__getitem__), cyclic


def test_whole_table_equals_its_plain_version(spark, sf_dir):
    """Order, cycles, missing dependencies and errors of every call of the table."""
    turns = [r for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows = queries.op2_tool_calls(spark, sf_dir).collect()
    moved = wrong = 0
    by_conversation = {}
    for t in turns:
        by_conversation.setdefault(t.conv_id, []).append(t)
    for conversation, own in by_conversation.items():
        asked = {f"{conversation}:{t.turn}": t for t in own if t.role == "user"}
        needs, errors = {}, {}
        for call, t in asked.items():
            nth, later, before = t.turn // 2, f"{conversation}:{t.turn + 2}", [f"{conversation}:{t.turn - 2}"] if t.turn >= 2 else []
            needs[call] = [later] if nth % 3 == 0 else [] if nth % 3 == 1 and conversation % 7 else before
            errors[call] = ["$: not JSON"] if nth % 11 == 10 else (["$.prompt: minLength is 1"] if t.text == "" else ["$.prompt: missing"] if t.text is None else []) + (["$.turn: not of type integer"] if nth % 5 == 4 else [])
        known = {c: [d for d in needed if d in asked] for c, needed in needs.items()}
        order, cyclic = plain_order({c: t.turn for c, t in asked.items()}, known)
        found = sorted((r for r in rows if r.conversation == conversation and r.n_calls), key=lambda r: r.place)
        assert [r.call_id for r in found] == order and {r.call_id for r in found if r.cyclic} == cyclic
        assert {r.call_id: r.missing_dependencies for r in found} == {c: len(needs[c]) - len(known[c]) for c in asked}
        assert {r.call_id: r.errors for r in found} == errors
        moved += order != sorted(order, key=lambda c: asked[c].turn)
        wrong += len(cyclic)
    assert moved > 5 and wrong > 1


def random_conversations(seed, conversations=8, calls=14):
    r = random.Random(seed)
    for conversation in range(conversations):
        for k in range(calls):
            needs = [f"{j:02d}" for j in range(calls) if j != k and r.random() < 0.08] + (["none"] if r.random() < 0.1 else [])
            yield conversation, f"{k:02d}", r.randrange(calls), "f", '{"x":1}', needs


def test_order_equals_its_definition_in_tasks_and_in_rounds(spark, monkeypatch):
    calls = list(random_conversations(4))
    for most in (1_000_000, 0):
        monkeypatch.setattr(tool_calls, "EDGES_IN_TASK", most)
        rows = linked(spark, calls, [])
        for conversation in {c[0] for c in calls}:
            own = [c for c in calls if c[0] == conversation]
            order, cyclic = plain_order({c[1]: c[2] for c in own}, {c[1]: [d for d in c[5] if d != "none"] for c in own})
            found = [r for r in rows if r.conversation == conversation]
            assert [r.call_id for r in found] == order
            assert {r.call_id for r in found if r.cyclic} == cyclic


def test_cycles_and_a_reversed_chain_in_long_conversations(spark):
    n = 2_000
    calls = [(1, f"{k:05d}", k, "f", '{"x":1}', [f"{k + 1:05d}"] if k < n - 1 else None) for k in range(n)]
    calls += [(2, f"{k:05d}", k, "f", '{"x":1}', ["00001"] if k == 0 else [f"{k - 1:05d}"]) for k in range(n)]
    rows = linked(spark, calls, [])
    assert [r.call_id for r in rows if r.conversation == 1] == [f"{k:05d}" for k in reversed(range(n))]
    assert all(r.cyclic for r in rows if r.conversation == 2) and not any(r.cyclic for r in rows if r.conversation == 1)


def test_odd_arguments_give_json_and_no_error_ends_the_job(spark):
    odd = ["1e999", '"\\ud800"', '{"a":"\\u001f"}', "NaN", "[" * 100_000 + "]" * 100_000, "9" * 6000, '{"a":1,"a":2}', " [1.50, true, null] ", "-0.0"]
    calls = [(1, f"c\u001f{k}", k, "any", a, None) for k, a in enumerate(odd)]
    rows = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(1, "c\u001f2", 9, "r\u001f\u2028")], RESULTS), {"any": {}}).collect()
    found = {r.call_id: r for r in rows}
    assert [found[c[1]].valid for c in calls] == [False, False, True, False, False, False, True, True, True]
    for r in rows:
        assert tool_calls.canonical(json.loads(r.message)) == r.message
    assert found["c\u001f2"].message == '{"arguments":{"a":"\\u001f"},"id":"c\\u001f2","name":"any","result":"r\\u001f\u2028"}'
    assert json.loads(found["c\u001f6"].message)["arguments"] == {"a": 2}


def test_arguments_are_as_deep_as_their_message_may_be():
    import sys

    for depth in range(sys.getrecursionlimit() - 60, 1100, 7):
        good, value = tool_calls.parsed("[" * depth + "]" * depth)
        if good:
            tool_calls.canonical({"arguments": value, "id": "x", "name": "n", "result": None})


def test_schema_keywords_judge_their_own_kind():
    check = tool_calls.violations
    assert check("abc", {"minimum": 3}) == check(3, {"minLength": 9}) == check(None, {"maxLength": 0, "maximum": -1}) == []
    assert check(2, {"type": ["string", "integer"]}) == [] and check(2.5, {"type": ["string", "integer"]}) == ["$: not of type string or integer"]
    assert check(True, {"type": "integer"}) and check(True, {"enum": [1]}) and not check(3.0, {"type": "integer"})
    assert not check(1.0, {"enum": [1]}) and not check({"a": [2]}, {"enum": [{"a": [2.0]}]}) and check("1", {"enum": [1]}) and check(1.5, {"enum": [1]})
    with pytest.raises(ValueError):
        tool_calls.refuse_unknown_types({"properties": {"a": {"type": "text"}}})
