"""Chat formatting: arguments that no message may break on, and orders by one pass and by rounds."""

import json
import random
import time

import pytest

from tidemark.llm import chat

SCHEMA = "conv string, turn long, role string, text string, call_id string, tool string, arguments string, answers string, after array<string>"


def brute(calls):
    """level and root of each call, by name; calls: name to (turn, after)."""
    out, busy = {}, set()

    def visit(c):
        if c in out:
            return out[c]
        if c in busy:
            return None
        busy.add(c)
        before = [visit(x) for x in calls[c][1] if x in calls]
        busy.discard(c)
        if None in before:
            return None
        out[c] = max([0, *(1 + b[0] for b in before)]), max([calls[c][0], *(b[1] for b in before)])
        return out[c]

    for _ in calls:
        for c in calls:
            visit(c)
    return out


@pytest.mark.parametrize("in_task", [1000, 0])
def test_orders(spark, monkeypatch, in_task):
    monkeypatch.setattr(chat, "IN_TASK", in_task)
    rng = random.Random(6)
    convs, rows = {}, []
    for conv, n in (("a", 25), ("b", 8), (None, 12), ("", 6)):
        names = [f"c{k}" for k in range(n)]
        convs[conv] = calls = {c: (k, [x for x in rng.sample(names, min(n, rng.randrange(3))) if names.index(x) < k or (conv == "b" and rng.random() < 0.5)] + (["gone", None] if k % 5 == 0 else [])) for k, c in enumerate(names)}
        rows += [(conv, t, "user", None, c, "t", "{}", None, after) for c, (t, after) in calls.items()]
    got = {(r.conv, r.call_id): r for r in chat.linked(spark.createDataFrame(rows, SCHEMA).repartition(3), {"t": {}}).collect()}
    for conv, calls in convs.items():
        want = brute(calls)
        for c in calls:
            r = got[conv, c]
            assert (r.level, r.root_turn, r.status) == ((2 * want[c][0], want[c][1], "open") if c in want else (0, calls[c][0], "cyclic"))


def test_a_ladder_settles_in_one_pass(spark):
    rows = [("x", k, "user", None, f"c{k}", "t", "{}", None, [f"c{k - 1}", f"c{k - 2}"]) for k in range(1000)]
    began = time.time()
    got = {r.turn: r.level for r in chat.linked(spark.createDataFrame(rows, SCHEMA), {"t": {}}).collect()}
    assert got == {k: 2 * k for k in range(1000)} and time.time() - began < 60


ARGUMENTS = {
    "[" * 100_000: "$: nested too deeply", "[" * 70 + "1" + "]" * 70: "$: nested too deeply", '{"a":"\\ud800"}': "$: lone surrogate", '{"\\udc00":1}': "$: lone surrogate", "NaN": "$: not JSON",
    "[Infinity]": "$: not JSON", "-1e999": "$: number not finite", "9" * 5000: "$: number too long", "{": "$: not JSON", "": "$: not JSON", "[" * 60 + "]" * 60: None, '"\\ud83d\\ude00"': None, "9" * 300: None, '{"b":1,"a":[1.5,null]}': None,
}


def test_arguments_that_break_nothing(spark):
    rows = [("x", k, "user", "hi", f"c{k}", "t", a, None, None) for k, a in enumerate(ARGUMENTS)]
    got = {r.turn: r for r in chat.linked(spark.createDataFrame(rows, SCHEMA), {"t": {}}).collect()}

    def no_constant(name):
        raise AssertionError(name)

    for k, (text, why) in enumerate(ARGUMENTS.items()):
        assert got[k].problems == ([why] if why else [])
        value = json.loads(got[k].message, parse_constant=no_constant)["tool_calls"][0]["arguments"]
        assert value == (text if why else json.loads(text))


def test_calls_alike_but_for_what_they_follow(spark):
    rows = [("x", 0, "user", None, "a", "t", "{}", None, None), ("x", 1, "user", None, "b", "t", "{}", None, ["a"]), ("x", 1, "user", None, "b", "t", "{}", None, ["b"])]
    for order in (rows, rows[::-1]):
        got = chat.linked(spark.createDataFrame(order, SCHEMA).repartition(1), {"t": {}}).collect()
        assert sorted((r.call_id, r.level, r.status) for r in got) == [("a", 0, "open"), ("b", 2, "open"), ("b", 2, "open")]
