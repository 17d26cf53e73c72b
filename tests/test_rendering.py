"""Filters, message normalisation and rendering on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions.arrays import fit_length, running_sum
from tracemill.functions.text import PLAIN, Template
from tracemill.operators import filters, render
from tracemill.schemas import TRAJECTORIES

CHAT = Template(prefix="<|im_start|>{role}\n", suffix="<|im_end|>\n", separator="")


def message(role, content, name=None, calls=None):
    return {"role": role, "content": content, "name": name, "tool_calls": calls}


def call(name, arguments):
    return {"function": {"name": name, "arguments": arguments}}


def frame(spark, **trajectories):
    rows = [
        {"trajectory_id": key, "trajectory": messages, "resolved": 1, "exit_status": "submit"}
        for key, messages in trajectories.items()
    ]
    return spark.createDataFrame(
        [tuple(row.get(name) for name in TRAJECTORIES.fieldNames()) for row in rows], TRAJECTORIES
    )


def expected(messages, template=PLAIN):
    """Text, assistant ranges and boundary, computed the plain way."""
    text, ranges = "", []
    for m in messages or []:
        if not m["content"]:
            continue
        if text:
            text += template.separator
        part = template.prefix.replace("{role}", m["role"] or "") + m["content"] + template.suffix
        if m["role"] == "assistant":
            ranges.append((len(text), len(text) + len(part)))
        text += part
    return text, ranges, ranges[0][0] if ranges else len(text)


CASES = {
    "plain": [message("system", "be kind"), message("user", "hi"), message("assistant", "hello"), message("user", "bye")],
    "assistant_first": [message("assistant", "a"), message("user", "b"), message("assistant", "c")],
    "no_assistant": [message("user", "one"), message("user", "two")],
    "holes": [message("user", None), message("assistant", ""), message("user", " "), message("assistant", "x")],
    "all_empty": [message("user", ""), message("assistant", None)],
    "no_role": [message(None, "who"), message("assistant", "me")],
    "unicode": [message("user", "é😀 é\n\nx"), message("assistant", "😀\n"), message("user", "]: [assistant]: no")],
}


@pytest.mark.parametrize("template", [PLAIN, CHAT])
def test_nested_rendering(spark, template):
    rows = {r.trajectory_id: r for r in render.render_trajectories(frame(spark, **CASES), template).collect()}
    for key, messages in CASES.items():
        row = rows[key]
        ranges = [(r["start"], r["end"]) for r in row.assistant_ranges]
        assert (row.text, ranges, row.prompt_boundary_char) == expected(messages, template)


@pytest.mark.parametrize("template", [PLAIN, CHAT])
def test_message_rows_give_the_same_parts(spark, template):
    nested = render.explode_parts(render.render_trajectories(frame(spark, **CASES), template), template, previous=True)
    rows = render.locate_parts(render.explode_messages(frame(spark, **CASES)), template, previous=True)
    assert sorted(nested.select(rows.columns).collect()) == sorted(rows.collect())
    assert rows.filter("trajectory_id = 'all_empty'").count() == 0


def test_null_and_empty_trajectories(spark):
    df = frame(spark, none=None, empty=[], some=CASES["plain"])
    assert [r.trajectory_id for r in filters.with_messages(df).collect()] == ["some"]
    rendered = {r.trajectory_id: (r.text, r.prompt_boundary_char) for r in render.render_trajectories(df).collect()}
    assert rendered["none"] == rendered["empty"] == ("", 0)


def test_part_invariants(spark):
    rendered = render.render_trajectories(frame(spark, **CASES))
    parts = render.explode_parts(rendered).join(rendered.select("trajectory_id", "text"), "trajectory_id")
    for p in parts.collect():
        assert p.text[p.char_start : p.char_end] == p.part
        assert p.n_chars == len(p.text)


def test_content_filter_keeps_white_space(spark):
    kept = filters.drop_empty_messages(render.explode_messages(frame(spark, holes=CASES["holes"])))
    assert [r.content for r in kept.orderBy("msg_idx").collect()] == [" ", "x"]


def test_gold_drops_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1, "submit"), ("b", 1, "error"), ("c", 0, "submit"), ("d", None, "submit"), ("e", 1, None)],
        "trajectory_id string, resolved int, exit_status string",
    )
    assert [r.trajectory_id for r in filters.gold(df).collect()] == ["a"]


@pytest.mark.parametrize("n, count", [(None, 5), (0, 5), (2, 2), (5, 5), (9, 5)])
def test_first_n(spark, n, count):
    df = spark.createDataFrame([(k,) for k in "edcba"], "trajectory_id string")
    expected_keys = list("abcde")[:count]
    assert sorted(r[0] for r in filters.first_n(df, n).collect()) == expected_keys


@pytest.mark.parametrize("last_keys", [1, 5, 4096])
def test_first_n_of_awkward_keys(spark, monkeypatch, last_keys):
    """Prefixes of one another, repeats, NULL, and letters beyond ASCII, whatever the number of rounds."""
    monkeypatch.setattr(filters, "_LAST_KEYS", last_keys)
    keys = ["", "a", "ab", "ab", "abc", "abcd", "abcde", "abd", "b", "\u00e9", "\u65e5\u672c", "\U0001f600", "x" * 300, "x" * 301]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "trajectory_id string")
    ordered = sorted(keys, key=str.encode)
    for n in (1, 3, 4, 7, 11, 13, 14, 15, 99):
        last = ordered[min(n, len(ordered)) - 1]
        wanted = [k for k in ordered if k.encode() <= last.encode()]
        got = sorted((r[0] for r in filters.first_n(df, n).collect()), key=str.encode)
        assert got == wanted, n
    plan = filters.first_n(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert filters.first_n(df.limit(0), 4).count() == 0


def test_length_thresholds(spark):
    # "[user]: " has 8 characters.
    df = frame(spark, short=[message("user", "x" * 91)], enough=[message("user", "x" * 92)], trail=[message("user", "x" * 90)])
    parts = render.locate_parts(render.explode_messages(df))
    assert [r.trajectory_id for r in filters.min_chars(parts).collect()] == ["enough"]
    trailing = render.locate_parts(render.explode_messages(df), trailing=True)
    assert sorted(r.trajectory_id for r in filters.min_chars(trailing).collect()) == ["enough", "short", "trail"]
    nested = render.render_trajectories(df, trailing=True)
    assert {r.trajectory_id: len(r.text) for r in nested.collect()} == {"short": 101, "enough": 102, "trail": 100}


def test_token_threshold_counts_after_truncation(spark):
    df = frame(spark, t=[message("user", "a " * 100)])
    parts = render.locate_parts(render.explode_messages(df))
    assert filters.min_tokens(parts, minimum=100).count() == 1
    assert filters.min_tokens(parts, minimum=100, max_tokens=99).count() == 0
    assert filters.min_tokens(parts, minimum=100, max_tokens=100).count() == 1


TOOLS = [
    message("assistant", "look:", calls=[call("ls", '{"b":1,"a":[1,2.50,"é"]}'), call(None, None)]),
    message("assistant", None, calls=[call("run", "not json"), {"function": None}]),
    message("assistant", None, calls=[{"function": None}]),
    message("assistant", "done", calls=[]),
    message("user", "ignored", calls=[call("x", "{}")]),
    message("tool", "out", name="shell"),
    message("tool", "", name=None),
    message("tool", None),
]


def plain_normalise(m, tool_role=False):
    role, content = m["role"], m["content"]
    if role == "assistant" and m["tool_calls"]:
        texts = []
        for c in m["tool_calls"]:
            if c["function"] and any(v is not None for v in c["function"].values()):
                raw = c["function"]["arguments"]
                try:
                    dumped = json.dumps(json.loads(raw if raw is not None else "{}"))
                except json.JSONDecodeError:
                    dumped = json.dumps(raw)
                texts.append(f"<tool_call>\n{c['function']['name'] or 'unknown'}({dumped})\n</tool_call>")
        content = (content or "") + "\n".join(texts)
    if role == "tool":
        content = f'<tool_response name="{m["name"] or "tool"}">\n{content or ""}\n</tool_response>'
        role = "tool" if tool_role else "user"
    return role, content


@pytest.mark.parametrize("tool_role", [False, True])
def test_tool_messages(spark, tool_role):
    df = frame(spark, t=TOOLS)
    rows = render.normalise_messages(render.explode_messages(df), tool_role).orderBy("msg_idx").collect()
    want = [plain_normalise(m, tool_role) for m in TOOLS]
    assert [(r.role, r.content) for r in rows] == want
    nested = render.normalise_trajectories(df, tool_role).first().trajectory
    assert [(m.role, m.content) for m in nested] == want


def test_template_must_keep_tokens_apart(spark):
    with pytest.raises(ValueError):
        render.locate_parts(render.explode_messages(frame(spark, **CASES)), Template(prefix="{role}: "))
    with pytest.raises(ValueError):
        render.locate_parts(render.explode_messages(frame(spark, **CASES)), Template(separator="and"))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 600, 1025])
def test_running_sum(spark, n):
    values = [(i * 7) % 13 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums = df.select(running_sum(F.col("v")).alias("s")).first().s
    assert sums == [sum(values[:i]) for i in range(n)]


def test_running_sum_is_not_nested_in_a_lambda(spark):
    df = spark.createDataFrame([("a b c",)], "t string")
    lengths = df.withColumn("l", F.transform(F.split("t", " "), lambda x: F.length(x)))
    plan = lengths.select(running_sum(F.col("l")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_fit_length(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    row = df.select(*(fit_length(F.col("v"), n, 9).alias(f"n{n}") for n in (0, 2, 3, 5))).first()
    assert list(row) == [[], [1, 2], [1, 2, 3], [1, 2, 3, 9, 9]]
