"""Tokens, masks, prompt windows, samples."""

import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions.text import TOKEN_PATTERN, last_token, token_count
from tracemill.operators import render, tokens
from test_rendering import CASES, expected, frame, message


def plain_tokens(messages):
    text, ranges, boundary = expected(messages)
    spans = [m.span() for m in re.finditer(TOKEN_PATTERN, text)]
    mask = [int(any(s < b and e > a for a, b in ranges)) for s, e in spans]
    first = next((i for i, (s, _) in enumerate(spans) if s >= boundary), len(spans))
    return text, spans, mask, first


LONG = {"long": [message("user" if i % 2 else "assistant", "w%d " % i * (i % 7)) for i in range(60)]}


@pytest.mark.parametrize("cases", [CASES, LONG])
def test_tokens_masks_and_boundaries(spark, cases):
    parts = render.locate_parts(render.explode_messages(frame(spark, **cases)), previous=True)
    rows = tokens.explode_tokens(parts).collect()
    bounds = {r.trajectory_id: r for r in render.prompt_boundary(parts).collect()}
    for key, messages in cases.items():
        text, spans, mask, first = plain_tokens(messages)
        got = sorted((r for r in rows if r.trajectory_id == key), key=lambda r: r.pos)
        assert [r.pos for r in got] == list(range(len(spans)))
        assert [(r.tok_start, r.tok_end) for r in got] == spans
        assert [r.token for r in got] == [text[s:e] for s, e in spans]
        assert [r.prev_token for r in got] == [None, *(text[s:e] for s, e in spans)][: len(spans)]
        assert [r.loss_mask for r in got] == mask
        if spans:
            assert bounds[key].prompt_boundary == first
            assert bounds[key].n_tokens == len(spans)


@pytest.mark.parametrize("limit", [1, 7, 8, 9, 10, 11, 40])
def test_truncation(spark, limit):
    parts = render.locate_parts(render.explode_messages(frame(spark, **LONG)))
    rows = tokens.explode_tokens(parts, offsets=False, max_tokens=limit).collect()
    assert sorted(r.pos for r in rows) == list(range(limit))


def test_dictionary_and_samples(spark):
    parts = render.locate_parts(render.explode_messages(frame(spark, **CASES)))
    rows = tokens.explode_tokens(parts, offsets=False)
    dictionary = tokens.token_dictionary(rows)
    ids = {r.token: r.token_id for r in dictionary.collect()}
    texts = {key: plain_tokens(m) for key, m in CASES.items()}
    counts = {}
    for text, spans, _, _ in texts.values():
        for s, e in spans:
            counts[text[s:e]] = counts.get(text[s:e], 0) + 1
    assert ids == {t: i for i, t in enumerate(sorted(counts, key=lambda t: (-counts[t], t.encode())))}
    samples = {r.trajectory_id: r for r in tokens.assemble_samples(tokens.encode(rows, dictionary), 10).collect()}
    for key, (text, spans, mask, _) in texts.items():
        if spans:
            assert samples[key].input_ids == [ids[text[s:e]] for s, e in spans[:10]]
            assert samples[key].loss_mask == mask[:10]
            assert samples[key].attention_mask == [1] * min(10, len(spans))


def test_samples_keep_large_numbers(spark):
    big = 2**31 - 1
    df = spark.createDataFrame([("t", 1, big, 1), ("t", 0, 0, 0)], "trajectory_id string, pos int, token_id int, loss_mask int")
    row = tokens.assemble_samples(df, big).first()
    assert (row.input_ids, row.loss_mask) == ([0, big], [0, 1])


def test_overlap_mask_and_boundary_token(spark):
    # A special token, tokens over both edges of the range, one token on each side of it.
    starts, ends = [0, 0, 8, 12, 18, 20], [0, 8, 12, 18, 20, 25]
    df = spark.createDataFrame(
        [(starts, ends, [(10, 19)], 10), (starts, ends, [], 99), ([], [], [(0, 5)], 0)],
        "s array<int>, e array<int>, r array<struct<start:int,end:int>>, b int",
    )
    rows = df.select(
        tokens.overlap_mask(F.col("s"), F.col("e"), F.col("r")).alias("m"),
        tokens.boundary_token(F.col("s"), F.col("b")).alias("t"),
    ).collect()
    assert [r.m for r in rows] == [[0, 0, 1, 1, 1, 0], [0] * 6, []]
    assert [r.t for r in rows] == [3, 6, 0]


def test_special_tokens_count_for_the_boundary(spark):
    df = spark.createDataFrame([([0, 0, 4], 0)], "s array<int>, b int")
    assert df.select(tokens.boundary_token(F.col("s"), F.col("b")).alias("t")).first().t == 0


def test_align_mask(spark):
    df = spark.createDataFrame([(None,), ([1, 0, 1, 1, 1],), ([1],), ([],)], "m array<int>")
    got = [r.a for r in df.select(tokens.align_mask(F.col("m"), F.lit(3)).alias("a")).collect()]
    assert got == [[1, 1, 1], [1, 0, 1], [1, 0, 0], [0, 0, 0]]


@pytest.mark.parametrize(
    "boundary, ids, mask",
    [
        (None, [1, 2, 3, 4], [1, 1, 1, 1]),
        (0, [9, 9, 9, 9], [0, 0, 0, 0]),
        (2, [1, 2, 9, 9], [1, 1, 0, 0]),
        (50, [1, 2, 3, 4], [1, 1, 1, 1]),
    ],
)
def test_prompt_window(spark, boundary, ids, mask):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [1] * 5, boundary)], "i array<int>, m array<int>, b int")
    got = df.select(*tokens.prompt_window(F.col("i"), F.col("m"), 4, F.col("b"), pad_id=9)).first()
    assert list(got) == [ids, mask]


def test_prompt_window_of_short_sequence(spark):
    df = spark.createDataFrame([([1, 2], [1, 1])], "i array<int>, m array<int>")
    got = df.select(*tokens.prompt_window(F.col("i"), F.col("m"), 4)).first()
    assert list(got) == [[1, 2, 0, 0], [1, 1, 0, 0]]


def test_valid_mask(spark):
    df = spark.createDataFrame([(1, [3]), (1, None), (0, [3])], "loss_mask int, top_ids array<int>")
    assert [(r.loss_mask, r.is_valid) for r in tokens.valid_mask(df).collect()] == [(1, 1), (0, 0), (0, 1)]


def test_tokenize_with_truncates(spark):
    def make():
        return lambda texts: [([ord(c) for c in t], [(i, i + 1) for i in range(len(t))]) for t in texts]

    df = spark.createDataFrame([("a", "xyz"), ("b", "")], "trajectory_id string, text string")
    rows = {r.trajectory_id: r for r in tokens.tokenize_with(df, make, max_tokens=2).collect()}
    assert (rows["a"].input_ids, rows["a"].tok_starts, rows["a"].tok_ends) == ([120, 121], [0, 1], [1, 2])
    assert rows["b"].input_ids == []


def test_tokenize_with_bounds_a_call(spark):
    """A call of the encoder gets texts of bounded size together, whatever the batch."""
    longest = tokens.SLICE_CHARS

    def make():
        def encode_all(texts):
            assert len(texts) == 1 or sum(len(t or "") for t in texts) <= longest
            return [([len(t or "")], [(0, len(t or ""))]) for t in texts]

        return encode_all

    rows = spark.range(0, 100, 1, 1).select(
        "id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), F.when(F.col("id") == 50, 300_000).otherwise(30_000))).alias("text")
    )
    found = {r.id: (r.input_ids, r.tok_starts, r.tok_ends) for r in tokens.tokenize_with(rows, make).collect()}
    assert len(found) == 100
    assert found[50] == ([300_000], [0], [300_000]) and found[7] == ([0], [0], [0])
    assert all(found[k] == ([30_000], [0], [30_000]) for k in range(100) if k not in (7, 50))


def test_counts_and_last_tokens_without_lists(spark):
    texts = ["", "a", "\n", "ab_9\n", "x" * 5000, "é", "né", "a😀", "😀😀b1", "\r\n", "a b\n\n", "--", "_"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", token_count(F.col("t")).alias("n"), last_token(F.col("t")).alias("last")).collect()
    for r in found:
        want = re.findall(TOKEN_PATTERN, r.t)
        assert (r.n, r.last) == (len(want), want[-1] if want else None)


def test_offsets_are_not_folded(spark):
    """A fold copies the sums so far for every token."""
    parts = render.locate_parts(render.explode_messages(frame(spark, **LONG)))
    plan = tokens.explode_tokens(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "array_append" not in plan and "array_insert" not in plan
