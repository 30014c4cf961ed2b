import json

from sievework.llm import chat

SCHEMAS = {"t": '{"type":"object","required":["a"],"properties":{"a":{"type":"integer"}},"additionalProperties":false}'}
CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, step string"
RESULTS = "conv_id long, call_id string, turn long, content string, status string"


def test_states_and_steps(spark):
    calls = [
        (1, "a", 0, "t", '{"a": 1}', ["c"], ""), (1, "b", 1, "t", '{"a": "x"}', [], ""), (1, "c", 2, "t", '{"a":2}', ["b", "gone"], ""), (1, "d", 3, "u", "{}", None, ""),
        (1, "e", 4, "t", "{bad", ["a", "b"], ""), (2, "x", 0, "t", '{"a":1}', ["y"], ""), (2, "y", 1, "t", '{"a":1}', ["x"], ""), (2, "z", 2, "t", '{"a":NaN}', ["y"], ""),
        (None, "n", 0, "t", '{"a":3}', [], ""), (1, None, 0, "t", "{}", [], ""), (3, "a", 0, "t", '{"a":5}', [], ""), (3, "a", 7, "t", '{"a":6}', [], ""), (4, "q", 0, "t", None, [], ""),
    ]
    results = [(1, "a", 9, "done é\n", ""), (1, "b", 9, None, ""), (1, "c", 9, "x", ""), (None, "n", 1, "r", ""), (3, "a", 1, "first", ""), (3, "a", 2, "second", ""), (5, "lost", 1, "r", "")]
    got = {(r.conv_id, r.call_id): r for r in chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()}
    assert {k: (r.status, r.step) for k, r in got.items()} == {
        (1, "a"): ("ok", 2), (1, "b"): ("bad_arguments", 0), (1, "c"): ("ok", 1), (1, "d"): ("unknown_tool", 0), (1, "e"): ("bad_json", 3), (2, "x"): ("cycle", None), (2, "y"): ("cycle", None), (2, "z"): ("cycle", None),
        (None, "n"): ("ok", 0), (3, "a"): ("ok", 0), (4, "q"): ("bad_json", 0), (5, "lost"): ("no_call", None),
    }
    assert got[1, "a"].json == '{"arguments":{"a":1},"call_id":"a","name":"t","result":"done é\\n","status":"ok","step":2,"turn":0}'
    assert json.loads(got[3, "a"].json)["result"] == "first" and json.loads(got[3, "a"].json)["arguments"] == {"a": 5}


def test_null_turns_and_large_ids(spark):
    big = (1 << 62) + 1
    calls = [(big, "a", None, "t", '{"a":1}', [], ""), (None, "b", 3, "t", '{"a":2}', None, ""), (big, "c", big, "t", '{"a":3}', ["a"], "")]
    got = {r.call_id: (r.conv_id, r.turn, r.step, json.loads(r.json)["turn"]) for r in chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([(big, "a", None, "x", "")], RESULTS), SCHEMAS).collect()}
    assert got == {"a": (big, None, 0, None), "b": (None, 3, 0, 3), "c": (big, big, 1, big)}
    rows = [(1, None, "user", "no number"), (1, None, "assistant", "nor here"), (1, 0, "user", "q"), (1, 1, "assistant", "a"), (None, None, None, None)]
    turns = chat.link_calls(*chat.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.SCHEMAS).collect()
    assert sorted((r.turn is None, r.status, r.step) for r in turns) == [(False, "ok", 0), (True, "no_result", 0)] or sorted((r.turn is None, r.status) for r in turns) == [(False, "ok"), (True, "bad_arguments")]


def test_empty(spark):
    assert chat.link_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).count() == 0


def test_schema_checks():
    assert chat.complies(1.0, {"type": "integer"}) and not chat.complies(True, {"type": "integer"})
    assert chat.complies([1, 2], {"type": "array", "items": {"type": "number"}}) and not chat.complies("abc", {"maxLength": 2})
    assert chat.canonical({"b": 1, "a": "é\u0001"}) == '{"a":"é\\u0001","b":1}'


def test_json_that_cannot_be_written_again(spark):
    huge = "1" + "0" * 400
    calls = [(1, "inf", 0, "t", '{"a":1e999}', [], ""), (1, "half", 1, "t", '{"a":"\\ud800"}', [], ""), (1, "huge", 2, "t", f'{{"a":{huge}}}', [], ""), (1, "deep", 3, "t", "[" * 100_000, [], "")]
    got = {r.call_id: (r.status, json.loads(r.json)["arguments"]) for r in chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    assert got == {"inf": ("bad_json", None), "half": ("bad_json", None), "huge": ("no_result", {"a": int(huge)}), "deep": ("bad_json", None)}
