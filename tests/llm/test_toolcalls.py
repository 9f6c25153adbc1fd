"""Tool calls against a plain rendering of the same rules, and small cases by hand."""

import json
import random

import pytest

from cutloom.llm import toolcalls as tc


def levels_of(calls):
    """calls: id -> references; rounds by hand."""
    level = {}
    while True:
        ready = {c: 1 + max((level[r] for r in refs if r in calls), default=-1) for c, refs in calls.items() if c not in level and all(r in level for r in refs if r in calls)}
        if not ready:
            return level
        level |= ready


def brute(messages, schemas):
    out = {}
    for conv in {m[0] for m in messages}:
        rows = sorted(m[1:] for m in messages if m[0] == conv)
        calls, results = {}, {}
        for turn, role, text in rows:
            if role == "assistant":
                for c in json.loads(text)["tool_calls"]:
                    calls.setdefault(c["id"], (turn, c))
            if role == "tool":
                r = json.loads(text)
                results.setdefault(r["tool_call_id"], []).append((turn, r.get("content")))
        refs = {i: tc.references(c.get("arguments")) for i, (_, c) in calls.items()}
        level = levels_of(refs)
        for i, (turn, c) in calls.items():
            best = min(((t <= turn, t, x) for t, x in results.get(i, [])), default=None)
            wrong = tc.faults(c.get("arguments"), {"type": "object"} | schemas[c["name"]])
            wrong += [f"unknown call {r}" for r in sorted(refs[i]) if r not in calls]
            line = json.dumps({"id": i, "name": c["name"], "arguments": c["arguments"]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            status = "missing" if best is None else "early" if best[0] else "linked"
            out[conv, i] = (turn, status, best and best[1], best and best[2], level.get(i), "; ".join(wrong), not wrong and i in level, line)
    return out


def test_query_matches_plain_rules(spark):
    sf = "/root/testdata/sf0.01"
    rows = tc.as_tool_messages(spark.read.parquet(f"{sf}/conversations.parquet")).filter("role in ('tool', 'assistant')").collect()
    want = brute([tuple(r) for r in rows], tc.SCHEMAS)
    got = {(r.conv_id, r.call_id): (r.turn, r.status, r.result_turn, r.result, r.level, r.faults, r.valid, r.canonical) for r in tc.op6_toolcalls(spark, sf).collect()}
    assert got == want and {v[1] for v in got.values()} >= {"linked", "missing"} and {v[4] for v in got.values()} >= {0, 1}
    assert {v[6] for v in got.values()} == {True, False}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_edges(spark):
    schemas = {"f": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    rows = [
        (1, 0, "tool", '{"tool_call_id":"a","content":"soon"}'),
        (1, 1, "assistant", call(("a", "f", {"x": 1.0}), ("b", "f", {"x": "${a}"}), ("c", "f", {"x": "${d}"}), ("d", "f", {"x": "${c}"}))),
        (1, 2, "assistant", call(("a", "f", {"x": 9}), ("e", "g", {}), ("h", "f", {"x": "${zz}"}), ("i", "f", '{"x": true}'))),
        (1, 3, "tool", '{"tool_call_id":"b","content":"late"}'),
        (1, 3, "tool", '{"tool_call_id":"b","content":"late"}'),
        (2, 0, "assistant", None), (2, 1, "assistant", "no JSON with \"tool_calls\""), (None, 1, "assistant", call(("q", "f", {}))),
        (2, 3, "assistant", '{"tool_calls": [{"id": "n", "name": "f", "arguments": {"x": NaN}}, 3, {"name": "f"}]}'), (2, 4, None, "x"),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, call_id string")
    out = {(r.conv_id, r.call_id): r for r in tc.link_calls(df, schemas).collect()}
    assert {k: (r.status, r.level, r.valid) for k, r in out.items()} == {
        (1, "a"): ("early", 0, True), (1, "b"): ("linked", 1, True), (1, "c"): ("missing", None, False), (1, "d"): ("missing", None, False),
        (1, "e"): ("missing", 0, False), (1, "h"): ("missing", 0, False), (1, "i"): ("missing", 0, False), (2, "n"): ("missing", 0, False),
    }
    assert out[1, "a"].canonical == '{"arguments":{"x":1},"id":"a","name":"f"}' and out[1, "i"].faults == ["$.x: not integer"]
    assert out[2, "n"].canonical is None and out[1, "h"].faults == ["unknown call zz"]
    places = {r.call_id: r.place for r in tc.ordered(tc.link_calls(df, schemas)).filter("conv_id = 1").collect()}
    assert places["a"] < places["b"] < places["c"]
    assert tc.link_calls(df.limit(0), schemas).count() == 0


def test_query_keeps_whole_texts_and_long_chains(spark, tmp_path):
    said = lambda turn, end: ("same beginning " * 40) + f"turn {turn} \"quoted\"\n{end}"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", said(t, end)) for c, end in ((1, "left"), (2, "right")) for t in range(41)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {(r.conv_id, r.turn): r for r in tc.op6_toolcalls(spark, str(tmp_path)).collect()}
    assert len(out) == 40
    for (conv, turn), r in out.items():
        arguments = json.loads(r.canonical)["arguments"]
        assert arguments["text" if turn % 3 == 0 else "query"] == said(turn, ("left", "right")[conv - 1])
        assert r.result == said(turn + 1, ("left", "right")[conv - 1])
        assert r.level == r.place == turn // 2


@pytest.mark.parametrize("most", [0, 25, tc.LINKS])  # rounds for all, for some, for none
def test_levels_of_any_graph(spark, monkeypatch, most):
    monkeypatch.setattr(tc, "LINKS", most)
    rng, rows, want = random.Random(5), [], {}
    for conv in range(30):
        n, most, back = rng.randrange(2, 60), rng.choice((1, 2, 3)), conv % 3 == 0  # back: references in both directions, with circles
        graph = {f"c{i}": {f"c{rng.randrange(n if back and rng.random() < 0.2 else max(i, 1))}" for _ in range(rng.randrange(most + 1))} if i else set() for i in range(n)}
        rows += [(conv, 0, "assistant", call(*((i, "f", {"x": ["${%s}" % r for r in sorted(refs)]}) for i, refs in graph.items())))]
        want |= {(conv, i): levels_of(graph).get(i) for i in graph}
    out = tc.link_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {}}).collect()
    assert {(r.conv_id, r.call_id): r.level for r in out} == want
    assert None in want.values() and max(v for v in want.values() if v is not None) > 5


def test_bad_messages_end_no_job(spark):
    deep = "[" * 20_000 + "]" * 20_000
    nested = "[" * 3_000 + "]" * 3_000
    one = lambda i, name, arguments: '{"tool_calls":[{"id":%s,"name":%s,"arguments":%s}]}' % (i, name, arguments)
    rows = [
        one('"a"', '{"x":1}', '{"x":1}'), one('"b"', "3", '{"x":1}'), one('"\\ud800"', '"f"', '{"x":1}'), one('"c"', '"\\udfff"', '{"x":1}'),
        one('"d"', '"f"', '{"x":"\\ud800"}'), one('"e"', '"f"', deep), one('"g"', '"f"', nested), one('"h"', '"odd"', '{"x":1}'), one('"i"', '"f"', "9" * 6000),
        one('"j"', '"f"', '{"x":"${\\ud800}"}'), one('"k"', "[]", "[]"), one("7", '"f"', "{}"), '{"tool_calls":{"id":"z"}}', one('"l"', '"f"', '{"\\ud800":1}'), one('"m"', '"f"', '{"x":1}'),
    ]
    df = spark.createDataFrame([(1, t, "assistant", x) for t, x in enumerate(rows)], "conv_id long, turn long, role string, text string")
    out = {r.call_id: r for r in tc.link_calls(df, {"f": {}, "odd": {"properties": {"x": {"type": "whatever"}}}}).collect()}
    assert out.keys() >= {"a", "b", "c", "d", "h", "j", "k", "l", "m"} and {c for c, r in out.items() if r.valid} == {"m"}
    assert out["a"].name is None and out["a"].faults == ["name is not a string"] and out["h"].faults == ["$.x: not whatever"]
    assert out["d"].canonical is None and "not valid Unicode" in out["d"].faults and out["m"].canonical == '{"arguments":{"x":1},"id":"m","name":"f"}'
    assert "g" not in out or out["g"].faults[-1] in ("nested too deep", "$: not object")
