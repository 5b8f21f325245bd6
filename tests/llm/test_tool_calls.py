import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import tool_calls as C

SCHEMA = {"f": {"type": "object", "properties": {"x": {"type": "number", "minimum": 0}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}}, "required": ["x"], "additionalProperties": False}}


def linked(spark, messages, **k):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return {r["id"]: r for r in C.link(C.extract(df), **k).collect()}


def call(i, args, after=None, name="f"):
    return f'see <tool_call>{json.dumps({"id": i, "name": name, "arguments": args} | ({"after": after} if after else {}))}</tool_call>'


def test_links_order_validation_and_json(spark):
    got = linked(
        spark,
        [
            (1, 0, "assistant", call("b", {"x": 2.0, "tags": ["b"]}, "a")), (1, 1, "assistant", call("a", {"x": -1})), (1, 2, "tool", '{"call_id":"b","content":{"z":1,"é":[1.50]}}'),
            (1, 3, "tool", '{"call_id":"nobody","content":1}'), (1, 4, "assistant", call("p", {"x": 1}, "q")), (1, 5, "assistant", call("q", {"x": 1}, "p")), (1, 6, "assistant", call("t", {"x": True, "y": 1}, "b")),
        ],
        schemas=SCHEMA,
    )
    assert {i: (r["status"], r["depth"], r["valid"], r["error"]) for i, r in got.items()} == {
        "a": ("no_result", 0, False, "$.x: range"), "b": ("linked", 1, True, None), "t": ("no_result", 2, False, "$.x: type"),
        "nobody": ("no_call", None, None, None), "p": ("no_result", None, True, None), "q": ("no_result", None, True, None),
    }
    assert got["b"]["json"] == '{"arguments":{"tags":["b"],"x":2},"id":"b","name":"f","result":{"z":1,"é":[1.5]}}'


def test_long_chain_and_repeats(spark):
    messages = [(7, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(400)]
    got = linked(spark, messages + messages[:6] * 50)
    assert all(got[f"7:{t}"]["depth"] == t // 2 and got[f"7:{t}"]["status"] == "linked" for t in range(0, 400, 2))
    assert got["7:0"]["n_calls"] == got["7:0"]["n_results"] == 51


def test_query_by_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    at = {(c, t): (r, x) for c, t, r, x in rows}
    got = {r["id"]: r for r in C.op8_tool_calls(spark, sf).collect()}
    want = {f"{c}:{t}" for (c, t), (r, _) in at.items() if r == "user"} | {f"{c}:{t - 1}" for (c, t), (r, _) in at.items() if r == "assistant"}
    assert set(got) == want
    for (c, t), (r, x) in at.items():
        if r == "user":
            g, n, u = got[f"{c}:{t}"], 0, t
            while at.get((c, u - 2), ("",))[0] == "user":
                n, u = n + 1, u - 2
            answered = at.get((c, t + 1), ("", None))
            assert g["depth"] == n and g["valid"] == bool(x) and g["status"] == ("linked" if answered[0] == "assistant" else "no_result")
            assert json.loads(g["json"]).get("result") == (answered[1] if answered[0] == "assistant" else None)


def test_odd_rows(spark):
    got = spark.createDataFrame([(None, 0, "user", "x"), (1, None, "assistant", None), (1, 1, None, "y"), (2, 0, "user", None), (3, 0, "tool", "not json"), (4, 0, "user", "<tool_call>{</tool_call>")], "conv_id long, turn long, role string, text string")
    rows = C.link(C.extract(got)).collect()
    assert sorted((str(r["conv_id"]), r["status"], r["valid"]) for r in rows) == [("1", "no_call", None), ("2", "no_result", False), ("3", "no_call", None), ("4", "no_result", False), ("None", "no_result", True)]
    assert C.link(C.extract(got.where("conv_id > 9"))).count() == 0


def test_ids_repeat_across_and_within_conversations(spark):
    answer = lambda c: json.dumps({"call_id": "call_1", "content": c})
    rows = [m for c in range(30) for m in ((c, 0, "assistant", call("call_1", {"x": c})), (c, 1, "tool", answer(c)))]
    rows += [(0, 2, "assistant", call("call_1", {"x": 100})), (0, 3, "tool", answer(100)), (1, 2, "tool", answer("more")), (2, 2, "assistant", call("next", {"x": 1}, "call_1"))]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "b"), (50, 1, "assistant", "c"), (50, 1, "assistant", "d"), (None, 0, "assistant", call("call_1", {"x": 7}))]
    df = spark.createDataFrame(rows + rows[:2], "conv_id long, turn long, role string, text string")
    got = C.link(C.extract(df), schemas=SCHEMA | C.SCHEMAS).collect()
    ones = [(r["conv_id"], json.loads(r["json"])) for r in got if r["id"] == "call_1" and r["status"] == "linked"]
    assert sorted((c, j["arguments"]["x"], j["result"]) for c, j in ones) == sorted([(c, c, c) for c in range(30)] + [(0, 100, 100)])
    assert [(r["conv_id"], json.loads(r["json"])["result"]) for r in got if r["status"] == "no_call"] == [(1, "more")]
    assert [(r["conv_id"], r["n_calls"]) for r in got if r["status"] == "no_result"] in ([(2, 1), (None, 1)], [(None, 1), (2, 1)])
    assert [r["depth"] for r in got if r["id"] == "next"] == [1]
    fifty = [json.loads(r["json"]) for r in got if r["conv_id"] == 50]
    assert sorted(j["arguments"]["text"] for j in fifty) == ["a", "b"] and sorted(j["result"] for j in fifty) == ["c", "d"]
    assert [r["n_calls"] for r in got if r["conv_id"] == 0 and r["turn"] == 0] == [2]


def test_messages_that_cannot_be_read(spark):
    """Each is a row with a reason; none ends the job."""
    wrap = lambda x: f"<tool_call>{x}</tool_call>"
    big, deep = "9" * 400, "[" * 100_000
    cases = {
        0: (wrap('{"id":"i","name":"f","arguments":{"x":%s}}' % big), True, None), 1: (wrap('{"id":"i","name":"f","arguments":{"x":%s}}' % ("9" * 5000)), False, "$: not JSON"),
        2: (wrap('{"id":"\\ud800","name":"f","arguments":{"x":1}}'), True, None), 3: (wrap('{"id":"i","name":"\\udfff","arguments":{}}'), False, "unknown function"),
        4: (wrap('{"id":"i","name":"f","arguments":' + deep + "]" * 100_000 + "}"), False, "$: nested too deeply"), 5: (wrap('{"id":"i","name":"f","arguments":{"x":NaN}}'), False, "$: not JSON"),
        6: (wrap('{"id":{"a":1},"name":"f","arguments":{"x":1}}'), False, "$.id: type"), 7: (wrap('{"id":7,"name":"f","arguments":{"x":1}}'), True, None), 8: (wrap("[1]"), False, "$: no object"),
        9: (wrap('{"id":"i","name":3,"arguments":{"x":1}}'), False, "$.name: type"), 10: (wrap('{"id":"i","name":"f","arguments":{"x":1e400}}'), None, None), 11: (wrap('{"id":"i","name":"f","arguments":{"x":-0.0,"x":2}}'), True, None),
        12: (wrap(""), False, "$: not JSON"), 13: (wrap('{"id":"i","name":"f","arguments":{"x":1},"after":[1]}'), False, "$.after: type"), 14: (wrap('{"id":"i","name":"f","arguments":{"x":1,"\\ud800":1}}'), False, None),
    }
    results = [(100 + i, 0, "tool", t) for i, t in enumerate(['{"call_id":"\\ud800","content":"\\udc00"}', '{"call_id":[1],"content":1}', "[" * 100_000, '{"call_id":1e999,"content":Infinity}', "[]", "null", '{"call_id":true}', "\ud7ff" + "x" * 1_000_000])]
    df = spark.createDataFrame([(i, 0, "assistant", c[0]) for i, c in cases.items()] + results, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.link(C.extract(df.withColumn("c", F.lit(1)).withColumn("nth", F.lit("x"))), schemas=SCHEMA).collect()}
    assert set(got) == {*cases, *range(100, 108)}
    for i, (_, valid, error) in cases.items():
        if valid is not None:
            assert got[i]["valid"] == valid and (error is None or got[i]["error"] == error), i
        json.loads(got[i]["json"])
    assert got[0]["json"] == '{"arguments":{"x":%s},"id":"i","name":"f"}' % big and got[2]["id"] == "\\ud800" and got[7]["id"] == "7"
    assert all(got[i]["status"] == "no_call" for i in range(100, 108)) and [got[i]["id"] for i in (100, 101, 103)] == ["\\ud800", None, None]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]":,.-+eEtrufalsn0123456789 \\\ud800xidnameargumentscall_', max_size=80), st.sampled_from(["user", "assistant", "tool", None]))
def test_any_text_gives_rows_arrow_can_hold(inner, role):
    for text in (inner, f"<tool_call>{inner}</tool_call>", '<tool_call>{"id":' + inner + ',"name":"f"}</tool_call>'):
        for row in C._parts(1, 2, role, text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")):
            assert len(row) == 9 and all(isinstance(x, (str, int, type(None))) for x in row)
            [x.encode() for x in row if isinstance(x, str)]


def test_canonical_is_stable():
    values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda c: st.lists(c) | st.dictionaries(st.text(), c), max_leaves=20)

    @settings(max_examples=200, deadline=None)
    @given(values)
    def check(v):
        once = C.canonical(v)
        assert C.canonical(json.loads(once)) == once

    check()
