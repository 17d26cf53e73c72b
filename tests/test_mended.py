"""Cases that once lost data or gave a wrong verdict."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill.operators import batching, lookup, scores, tokens
from tracemill.plans.evaluate import assign_epoch
from tracemill.sources import trajectories as stored

SAMPLES = "trajectory_id string, input_ids array<int>, loss_mask array<int>, prompt_boundary int"


@pytest.mark.parametrize(
    "answer",
    [
        lambda batch: None,
        lambda batch: [None for _ in batch],
        lambda batch: [[{1: 0.0}] * (len(x) + 1) for x in batch],
        lambda batch: [[{1: 0.0}] * (len(x) - 1) for x in batch],
        lambda batch: [],
        lambda batch: [7 for _ in batch],
    ],
)
def test_every_sequence_is_answered(spark, answer):
    df = spark.createDataFrame([("a", [1, 2], [1, 1], 0), ("b", [], [], 0), ("c", [3], [1], 0)], SAMPLES)
    rows = scores.score_with(df, lambda: answer).collect()
    assert sorted((r.trajectory_id, r.status) for r in rows) == [("a", "error"), ("b", "error"), ("c", "error")]


def test_unknown_tokens_are_kept_or_refused(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 0), ("a", 2, "x", 1)], "trajectory_id string, pos int, token string, loss_mask int")
    dictionary = spark.createDataFrame([("x", 5, 0)], "token string, n long, token_id int")
    kept = tokens.assemble_samples(tokens.encode(rows, dictionary, unk_id=9)).first()
    assert kept.input_ids == [0, 9, 0] and kept.loss_mask == [1, 0, 1]
    with pytest.raises(Exception, match="dictionary"):
        tokens.assemble_samples(tokens.encode(rows, dictionary)).collect()


def test_absent_formats(spark):
    df = spark.createDataFrame(
        [(0, None, [[1.0]], [1]), (0, "logits", [[1.0]], [1]), (1, None, [[1.0]], [1]), (1, None, [[1.0]], [1])],
        "batch_id long, format string, teacher_values array<array<float>>, loss_mask array<int>",
    )
    got = {r.batch_id: (r.format, r.is_uniform) for r in batching.batch_metadata(df).collect()}
    assert got == {0: ("logits", False), 1: ("logprobs", True)}


def test_keys_without_rank_are_found(spark):
    table = spark.createDataFrame([("a", 0, 10), ("b", None, 20)], "key string, rank int, value int")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string")
    found = {r.key: r.value for r in lookup.lookup(rows, table, "key", "rank").collect()}
    assert found == {"a": 10, "b": 20, "c": None, None: None}


def test_validation_keeps_its_order(spark):
    ids = spark.range(200).select(F.col("id").cast("string").alias("trajectory_id"))

    def placed(epoch, split):
        rows = assign_epoch(ids, epoch, 4).where(F.col("split") == split).collect()
        return {(r.trajectory_id, r.batch_id, r.slot) for r in rows}

    assert placed(0, "val") == placed(1, "val")
    assert placed(0, "train") != placed(1, "train")


def test_broken_lines_are_set_aside(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps({"trajectory_id": "a"}) + "\n{broken\n")
    rows, broken = stored.load_json_lines(spark, str(path))
    assert [r.trajectory_id for r in rows.collect()] == ["a"] and [r.line for r in broken.collect()] == ["{broken"]
    with pytest.raises(Exception):
        stored.load_trajectories(spark, str(path), "json").collect()


def test_mask_by_search_equals_overlap(spark):
    def encoder():
        return lambda texts: [([1, 2, 3, 4], [(0, 0), (0, 3), (3, 5), (5, 9)]) for _ in texts]

    schema = "text string, spans array<struct<start:int,end:int>>"
    df = spark.createDataFrame([("x", [(1, 2), (4, 5)]), ("x", []), ("x", None), ("x", [(0, 9)])], schema)
    rows = tokens.tokenize_with(df, encoder, ranges="spans")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    both = rows.withColumn("spans", spans).select("loss_mask", tokens.overlap_mask(F.col("tok_starts"), F.col("tok_ends"), F.col("spans")).alias("m"))
    assert all(r.loss_mask == r.m for r in both.collect())


def test_looked_up_entries_are_not_shuffled_again(spark):
    """Rows that meet by position are shuffled before their entries are looked up, with or without a rest of keys."""
    schema = "t string, pos int, key string"
    rows = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("b", 1, None), ("b", 2, "none")], schema)
    table = spark.createDataFrame([("x", 0, [1]), ("y", 1, [2]), ("z", 2, [3])], "key string, rank int, wide array<int>")
    for head_rows in (1, 100):
        found = lookup.lookup(rows, table, "key", "rank", head_rows=head_rows, by=["t", "pos"])
        other = lookup.lookup(rows, table.withColumnRenamed("wide", "other"), "key", "rank", head_rows=head_rows, by=["t", "pos"])
        both = found.select("t", "pos", "wide").join(other.select("t", "pos", "other").hint("merge"), ["t", "pos"], "left")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning(t#" in x and "ENSURE_REQUIREMENTS" in x]
        got = {(r.t, r.pos): (r.wide, r.other) for r in both.collect()}
        assert got == {("a", 0): ([1], [1]), ("a", 1): ([2], [2]), ("b", 0): ([3], [3]), ("b", 1): (None, None), ("b", 2): (None, None)}
