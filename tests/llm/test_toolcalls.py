import json
import re

from glanage.llm import toolcalls as t

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, n long, label string"
RESULTS = "conv_id long, call_id string, turn long, content string, r string"
SCHEMAS = [("f", "q", "string", True), ("f", "n", "number", False), ("f", "flag", "boolean", False)]


def run(spark, calls, results, schemas=SCHEMAS):
    c = spark.createDataFrame([(*x, 1, "clash") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, "clash") for x in results], RESULTS)
    s = spark.createDataFrame(schemas, "tool string, parameter string, type string, required boolean")
    return sorted(t.link(c, r, s).collect(), key=lambda x: (x["conv_id"], x["seq"]))


def call(i, turn, args='{"q":"x"}', deps=(), name="f", conv=1):
    return (conv, i, turn, name, args, list(deps))


def test_validation(spark):
    cases = {
        "a": ('{"q": "x", "n": 1.5, "flag": true}', ""),
        "b": ('{"n": 2}', "missing q"),
        "c": ('{"q": 5, "zz": null}', "unknown zz; type of q"),
        "d": ("not json", "arguments are no object"),
        "e": (None, "arguments are no object"),
        "f": ("[1]", "arguments are no object"),
        "g": ('{"q": "x", "flag": "no", "n": "1"}', "type of flag; type of n"),
    }
    got = run(spark, [call(k, i, a) for i, (k, (a, _)) in enumerate(cases.items())], [(1, k, 50, "ok") for k in cases])
    assert {r["call_id"]: r["errors"] for r in got} == {k: e for k, (_, e) in cases.items()}
    assert json.loads(got[0]["json"]) == {"arguments": {"q": "x", "n": 1.5, "flag": True}, "call_id": "a", "errors": [], "name": "f", "result": {"content": "ok", "turn": 50}}
    assert '"arguments":{"flag":true,"n":1.5,"q":"x"}' in got[0]["json"]
    (other,) = run(spark, [call("x", 1, name="unheard")], [(1, "x", 2, None)])
    assert other["errors"] == "unknown tool" and json.loads(other["json"])["result"] == {"content": None, "turn": 2}


def test_order(spark):
    calls = [call("a", 1, deps=["c"]), call("b", 2), call("c", 5, deps=["d"]), call("d", 5), call("e", 3, deps=["a"]), call("f", 9, deps=["nowhere"])]
    got = run(spark, calls, [])
    order = [r["call_id"] for r in got]
    for before, after in (("d", "c"), ("c", "a"), ("a", "e")):
        assert order.index(before) < order.index(after)
    assert order[0] == "b" and [r["seq"] for r in got] == [1, 2, 3, 4, 5, 6]
    assert got[-1]["errors"] == "no dependency nowhere; call without result"


def test_random_orders_are_topological(spark):
    import random

    rng = random.Random(3)
    calls = [call(f"k{i}", rng.randrange(0, 900), deps=[f"k{j}" for j in rng.sample(range(i), min(i, 2))] if rng.random() < 0.3 else []) for i in range(200)]
    at = {r["call_id"]: r["seq"] for r in run(spark, calls, [])}
    assert sorted(at.values()) == list(range(1, 201))
    assert all(at[d] < at[c[1]] for c in calls for d in c[5])


def test_cycle(spark):
    calls = [call("a", 1, deps=["b"]), call("b", 2, deps=["a"]), call("c", 3), call("d", 4, deps=["c", "a"]), call("e", 0, deps=["e"]), call("f", 1, deps=["g"]), call("g", 7, deps=["c"]), call("a", 1, conv=2), call("b", 1, deps=["a"], conv=2)]
    got = run(spark, calls, [])
    assert {(r["conv_id"], r["call_id"]) for r in got if "cyclic dependency" in r["errors"]} == {(1, x) for x in "abde"}
    order = [r["call_id"] for r in got if r["conv_id"] == 1]
    assert order.index("c") < order.index("g") < order.index("f")


def test_long_chain_of_later_calls(spark):
    n = 150
    calls = [call(f"k{i}", i, deps=[f"k{i + 1}"] if i < n - 1 else []) for i in range(n)] + [call("z", 3, conv=2)]
    got = [r for r in run(spark, calls, []) if r["conv_id"] == 1]
    assert [r["call_id"] for r in got] == [f"k{i}" for i in reversed(range(n))] and not any("cyclic" in r["errors"] for r in got)


def test_canonical_json(spark):
    cases = {
        "1e2": "100", "100.0": "100", "-0.0": "0", "-1.50": "-1.5", "1.0E22": "1e+22", "0.00001": "0.00001", "1.25e-9": "1.25e-9", "123456789012": "123456789012",
        '{"b": [1.0, "2.50 \\" 1e5 \\\\"], "a": 1e1}': '{"a":10,"b":[1,"2.50 \\" 1e5 \\\\"]}',
    }
    got = run(spark, [call(f"k{i}", i, '{"q": "1.50", "x": %s}' % v) for i, v in enumerate(cases)], [])
    assert [r["json"].split('"x":')[1].split(',"call_id"')[0][:-1] for r in got] == list(cases.values())
    for r, v in zip(got, cases):
        assert json.loads(r["json"])["arguments"] == {"q": "1.50", "x": json.loads(v)}
    (a, b) = run(spark, [call("a", 1, '{"q": 1, "n": 2, "q": 3}'), call("b", 2, '{"q": {"u": 1, "u": 2}}')], [(1, "a", 2, ""), (1, "b", 3, "")])
    assert (a["errors"], b["errors"]) == ("repeated q", "repeated keys within")


def test_odd_rows(spark):
    calls = [call("a", 1), call("a", 1), call(None, 2), (None, "z", 1, "f", None, None), (1, "b", None, None, None, None), call("long", 4, json.dumps({"q": "x\n\"é" * 50_000}))]
    results = [(1, "a", 3, "later"), (1, "a", 2, "r"), (1, "lost", 7, ""), (None, "a", 1, "x"), (1, None, 1, "x")]
    got = {r["call_id"]: r for r in run(spark, calls, results)}
    assert set(got) == {"a", "b", "lost", "long"}
    assert got["a"]["errors"] == "more calls of this id; more results of this id" and json.loads(got["a"]["json"])["result"]["turn"] == 2
    assert got["lost"]["errors"] == "result without call" and json.loads(got["lost"]["json"])["arguments"] is None
    assert json.loads(got["long"]["json"])["arguments"]["q"] == "x\n\"é" * 50_000
    assert run(spark, [], []) == [] and run(spark, [], [(1, "x", 1, "y")])[0]["seq"] == 1
    assert run(spark, [call("a", 1)], [], schemas=[])[0]["errors"] == "unknown tool; call without result"


def test_conversations_and_plan(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'say "hi"'), (1, 2, "assistant", "hi"), (1, 3, "user", None), (2, None, "user", "x"), (None, 1, "user", "x"), (3, 4, "assistant", "alone")]
    c, r = t.from_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    df = t.link(c, r, spark.createDataFrame(list(t.TOOLS), "tool string, parameter string, type string, required boolean"))
    got = {x["call_id"]: x for x in df.collect()}
    assert set(got) == {"call_1_1", "call_1_3", "call_3_3"} and json.loads(got["call_1_1"]["json"])["arguments"]["query"] == 'say "hi"'
    assert not re.search("Python|Pandas|ArrowEval", df._jdf.queryExecution().executedPlan().toString())
