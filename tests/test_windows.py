"""A user's tokenizer over windows against the same tokenizer over whole texts; lookups by bytes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill import fixtures as fx
from tracemill.operators import windows
from tracemill.operators.lookup import frequent_head, lookup
from tracemill.operators.render import locate_parts

PATTERN = re.compile(r"[^ \t\n]+|[ \t\n]+")


def _messages(spark, texts):
    rows = [(t, i, role, content) for t, messages in texts.items() for i, (role, content) in enumerate(messages)]
    return spark.createDataFrame(rows, "trajectory_id string, msg_idx int, role string, content string")


def _whole(messages):
    """Text, tokens with offsets, and mask of one trajectory, worked out plainly."""
    parts, text, spans = [(r, f"[{r}]: {c}") for r, c in messages if c], "", []
    for role, part in parts:
        text += "\n\n" if text else ""
        if role == "assistant":
            spans.append((len(text), len(text) + len(part)))
        text += part
    found = [m.span() for m in PATTERN.finditer(text)]
    mask = [int(any(s < b and e > a for a, b in spans)) for s, e in found]
    return [s for s, _ in found], [e for _, e in found], [e - s for s, e in found], mask


def _together(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.trajectory_id, r.window)):
        lists = out.setdefault(r.trajectory_id, ([], [], [], []))
        assert r.first_pos == len(lists[0])
        for into, values in zip(lists, (r.tok_starts, r.tok_ends, r.input_ids, r.loss_mask)):
            into += values
    return out


@pytest.mark.parametrize("window, overlap", [(64, 32), (100, 40), (1000, 64)])
def test_windows_equal_whole_texts(spark, window, overlap):
    rng = random.Random(window)
    words = ["a", "bcd", "é€", "𝒳y", "longer" * 3, "\n", "  "]
    texts = {
        f"t{k}": [
            (rng.choice(["user", "assistant"]), " ".join(rng.choices(words, k=rng.randint(1, 80)))) for _ in range(rng.randint(1, 6))
        ]
        for k in range(12)
    }
    # A token of 700 characters, one over a border of parts, an empty message, a short text.
    texts["long"] = [("user", "x" * 700 + " end"), ("assistant", "z" * 90), ("user", ""), ("user", " " * 300 + "q")]
    texts["short"] = [("user", "y")]
    texts["empty"] = [("user", "")]
    parts = locate_parts(_messages(spark, texts))
    got = _together(windows.windowed_tokens(parts, fx.word_encoder(), window=window, overlap=overlap, agree=4).collect())
    want = {k: _whole(v) for k, v in texts.items() if k != "empty"}
    assert got == want


@pytest.mark.parametrize("run_chars", [1, 200])
def test_runs_of_windows_equal_whole_texts(spark, monkeypatch, run_chars):
    monkeypatch.setattr(windows, "RUN_CHARS", run_chars, raising=False)
    rng = random.Random(7)
    words = ["a", "bcd", "é€", "𝒳y", "longer" * 3, "\n", "  "]
    texts = {f"t{k}": [("user", " ".join(rng.choices(words, k=9))), ("assistant", " ".join(rng.choices(words, k=150 + k)))] for k in range(6)}
    # No windows of 64 agree inside the long token, which stands in one run of several.
    texts["long"] = [("user", "ab " * 200 + "x" * 700), ("assistant", "cd " * 200)]
    parts = locate_parts(_messages(spark, texts))
    rows = windows.windowed_tokens(parts, fx.word_encoder(), window=64, overlap=32, agree=4)
    assert _together(rows.collect()) == {k: _whole(v) for k, v in texts.items()}


def test_windows_are_written_once(spark, monkeypatch):
    written = []

    def materialise(df, name):
        written.append(name)
        return store(df, name)

    store = windows.materialise
    monkeypatch.setattr(windows, "materialise", materialise)
    parts = locate_parts(_messages(spark, {"t": [("user", "ab cd " * 60)], "u": [("assistant", "k")]}))
    windows.windowed_tokens(parts, fx.word_encoder(), window=128, overlap=64)
    assert written == ["windows"]


def test_special_tokens_once(spark):
    def make():
        plain = fx.word_encoder()()

        def encode(texts):
            return [([-1, *ids, -2], [(0, 0), *spans, (0, 0)]) for ids, spans in plain(texts)]

        return encode

    texts = {"t": [("user", "ab cd " * 60)], "u": [("assistant", "k")]}
    rows = windows.windowed_tokens(locate_parts(_messages(spark, texts)), make, window=80, overlap=40, agree=4)
    for name, (starts, ends, ids, mask) in _together(rows.collect()).items():
        want = _whole(texts[name])
        assert (ids[0], ids[-1]) == (-1, -2) and ids[1:-1] == want[2] and starts[1:-1] == want[0]
        assert mask[1:-1] == want[3] and mask[0] == mask[-1] == 0


def test_windows_are_bounded_and_cover_the_text(spark):
    parts = locate_parts(_messages(spark, {"t": [("user", "w" * 5000), ("assistant", "v " * 900)]}))
    rows = windows.text_windows(parts, 256, 32).orderBy("window").collect()
    assert max(len(r.text) for r in rows) <= 256 + 64 and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    text = "[user]: " + "w" * 5000 + "\n\n[assistant]: " + "v " * 900
    assert all(r.text == text[r.base : r.base + len(r.text)] for r in rows)
    with pytest.raises(ValueError):
        windows.windowed_tokens(parts, fx.word_encoder(), window=10, overlap=8)


def test_head_is_cut_by_bytes(spark):
    table = spark.createDataFrame([("é" * 10, 0), ("ab", 1), ("w" * 600, 2), ("cd", 3), ("ef", None)], "key string, rank int")
    assert [r.key for r in frequent_head(table, "key", "rank", head_bytes=22).collect()] == ["é" * 10, "ab"]
    assert [r.key for r in frequent_head(table, "key", "rank").orderBy("rank").collect()] == ["é" * 10, "ab", "cd"]


@pytest.mark.parametrize("head_bytes", [0, 3, 1 << 20])
def test_lookup_starts_no_job_while_planning(spark, head_bytes):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "zz")], "i int, key string")
    table = spark.createDataFrame([("a", 0), ("bb", 1), ("c" * 900, 2)], "key string, rank int")
    context = spark.sparkContext
    context.setJobGroup("planning", "planning")
    found = lookup(rows, table, "key", "rank", head_bytes=head_bytes)
    assert not context.statusTracker().getJobIdsForGroup("planning")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.i: r.rank for r in found.collect()} == {1: 0, 2: 1, 3: None, 4: None}
    assert lookup(rows, table.limit(0), "key", "rank").where(F.col("rank").isNull()).count() == 4


def test_windows_stay_as_wide_as_asked(spark):
    text = " ".join(f"word{i}" for i in range(400))
    parts = locate_parts(_messages(spark, {"t": [("user", text), ("assistant", text)]}))
    rows = windows.windowed_tokens(parts, fx.word_encoder(), window=256, overlap=64).collect()
    length = sum(len(f"[{role}]: {text}") for role in ("user", "assistant")) + 2
    assert sorted(r.window for r in rows) == list(range((length - 1) // 256 + 1))
    assert max(max(r.tok_ends) - min(r.tok_starts) for r in rows) <= 256 + 2 * 64
    assert sum(len(r.input_ids) for r in rows) == len(PATTERN.findall(f"[user]: {text}\n\n[assistant]: {text}"))
