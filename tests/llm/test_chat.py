import json

from tapeline.llm import chat

CALLS = "conv long, turn long, id string, name string, arguments string, refers array<string>, place string"
RESULTS = "conv long, turn long, id string, content string"


def test_links_order_checks_and_lines(spark):
    calls = spark.createDataFrame([
        (1, 1, "a", "search", '{"query": "é \\"q\\"", "limit": 3}', ["b"], ""), (1, 3, "b", "lookup", '{"deep": 1, "x": 2}', ["gone", None], ""), (1, 5, "c", "score", '{"value": 1.5}', ["a"], ""),
        (1, 3, "b", "lookup", '{"deep": 1, "x": 2}', ["gone", None], ""), (1, 9, "b", "search", "{}", None, ""), (2, 1, "a", "score", "[1]", ["b"], ""), (2, 2, "b", None, "oops", ["a"], ""), (2, 3, "z", "score", None, None, ""),
        (None, 4, "n", "search", '{"query": null}', None, ""), (3, None, None, "score", '{"value": "1"}', [], "")], CALLS)
    results = spark.createDataFrame([(1, 4, "a", "late"), (1, 2, "a", "first\n"), (2, 1, "a", None), (9, 1, "a", "x"), (None, 1, "n", "x")], RESULTS)
    got = {(r.conv, r.id): r for r in chat.link_calls(calls, results, chat.SCHEMAS, rounds=5).collect()}
    assert len(got) == 8
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert b.place < a.place < c.place and a.ordered and b.ordered and c.ordered
    assert json.loads(a.line) == {"arguments": {"limit": 3, "query": 'é "q"'}, "id": "a", "name": "search", "result": "first\n"} and a.line.startswith('{"arguments":{"limit":3,"query"')
    assert a.problems == [] and c.problems == [] and b.problems == ["deep is not boolean", "missing key", "unknown field x"]
    assert a.answered and not b.answered and got[2, "a"].answered
    assert not (got[2, "a"].ordered and got[2, "b"].ordered)
    assert got[2, "a"].problems == ["arguments are not an object"] and got[2, "b"].problems == got[2, "z"].problems == ["arguments are not JSON"]
    assert json.loads(got[2, "b"].line) == {"arguments": "oops", "id": "b"}
    assert got[3, None].problems == ["value is not number"] and not got[None, "n"].answered
    assert chat.link_calls(calls.limit(0), results.limit(0), chat.SCHEMAS).collect() == []


def test_long_chains_need_no_rounds(spark):
    n = 3000
    calls = spark.createDataFrame([(1, i, f"k{i}", "score", '{"value": 1}', [f"k{i - 1}"], "") for i in range(n)], CALLS)
    got = chat.link_calls(calls, spark.createDataFrame([], RESULTS), chat.SCHEMAS).collect()
    assert all(r.ordered and r.place == r.turn for r in got) and len(got) == n


def test_forward_chains_of_any_depth(spark):
    n = 100
    rows = [(1, i, f"k{i}", "score", None, [f"k{i + 1}"], "") for i in range(n)]
    # Two references each, a cycle of three, one behind it, and one that refers to itself.
    rows += [(2, i, f"k{i}", "score", None, [f"k{i + 1}", f"k{(i * 7 + 3) % n}" if (i * 7 + 3) % n > i else "gone"], "") for i in range(n)]
    rows += [(3, t, i, "score", None, r, "") for t, i, r in ((1, "a", ["b"]), (2, "b", ["c"]), (3, "c", ["a", "f"]), (4, "d", ["f", "b"]), (5, "e", ["e"]), (6, "f", []), (7, "g", ["f"]))]
    got = {(r.conv, r.id): r for r in chat.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), chat.SCHEMAS).collect()}
    for conv in (1, 2):
        assert [got[conv, f"k{i}"].place for i in range(n)] == [2 * n - 2 - i for i in range(n)]
        assert all(got[conv, f"k{i}"].ordered for i in range(n))
    assert {i: got[3, i].ordered for i in "abcdefg"} == {**dict.fromkeys("abcde", False), "f": True, "g": True}
    assert all(got[3, i].place == got[3, i].turn for i in "abcdefg")


def test_query_has_forward_links_without_cycles(spark):
    rows = [(1, t, "assistant", "x" * 30) for t in range(1, 40, 2)] + [(2, t, "assistant", "y") for t in range(0, 40, 2)]
    calls = chat.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.link_calls(calls, spark.createDataFrame([], RESULTS), chat.SCHEMAS).collect()
    assert all(r.ordered for r in got) and sum(r.place > r.turn for r in got) >= 6


def test_query_calls_hold_whole_texts(spark):
    rows = [(k, t, "assistant", text) for k, text in enumerate(['é "q" \\ \n\t\x01 {}' + "z" * m for m in (0, 1, 2, 300_000)]) for t in range(8)]
    calls = chat.conversation_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat.link_calls(calls, spark.createDataFrame([], RESULTS), chat.SCHEMAS).collect()
    want = {(k, f"call-{t}"): text for k, t, _, text in rows}
    assert len(got) == 32 and all(want[r.conv, r.id] in json.loads(r.line)["arguments"].values() for r in got)
    assert {p for r in got for p in r.problems} == {"missing key", "unknown field keys", "value is not number", "unknown field extra", "unknown tool erase"}
