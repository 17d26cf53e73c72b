"""Split, batches, padding, profiles and running metrics."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.operators import batching, profile
from tracemill.plans.evaluate import assign_epoch


def ids(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("trajectory_id"))


@pytest.mark.parametrize("n, n_val", [(1, 1), (19, 1), (40, 2), (59, 2), (333, 16)])
def test_split_sizes(spark, n, n_val):
    rows = batching.split_train_val(ids(spark, n)).collect()
    assert len({r.trajectory_id for r in rows}) == n
    assert sum(r.split == "val" for r in rows) == n_val
    again = batching.split_train_val(ids(spark, n).repartition(3)).collect()
    assert sorted(rows) == sorted(again)


def test_split_overlap(spark):
    df = spark.createDataFrame([("x", "train"), ("x", "val"), ("y", "train"), ("z", "val"), ("z", "val")], "instance_id string, split string")
    assert list(batching.split_overlap(df).first()) == [3, 1]


def test_shuffle_depends_on_epoch_only(spark):
    first, second = ({r.trajectory_id: r.idx for r in batching.shuffled_index(ids(spark, 100), e).collect()} for e in (0, 1))
    assert sorted(first.values()) == sorted(second.values()) == list(range(100))
    assert first != second


def test_assign_epoch(spark):
    rows = assign_epoch(ids(spark, 50), 3, 8).collect()
    assert len({r.trajectory_id for r in rows}) == 50
    train = [r for r in rows if r.split == "train"]
    assert (len(train), len(rows) - len(train)) == (48, 2)
    assert sorted((r.batch_id, r.slot) for r in train) == [(b, s) for b in range(6) for s in range(8)]


def test_partial_last_batch(spark):
    rows = batching.assign_batches(batching.sample_index(ids(spark, 11)), 4).collect()
    assert sorted((r.batch_id, r.slot) for r in rows) == [(i // 4, i % 4) for i in range(11)]
    assert [r.trajectory_id for r in sorted(rows, key=lambda r: r.idx)] == sorted(map(str, range(11)))


@pytest.mark.parametrize("cap, width", [(None, 4), (0, 4), (3, 3), (9, 4)])
def test_pad_batch(spark, cap, width):
    df = spark.createDataFrame(
        [("a", 0, [5, 6, 7, 8], [1] * 4, [0, 1, 1, 1]), ("b", 0, [5], [1], [1]), ("c", 1, [5, 6], [1, 1], [0, 0])],
        "trajectory_id string, batch_id bigint, input_ids array<int>, attention_mask array<int>, loss_mask array<int>",
    )
    rows = {r.trajectory_id: r for r in batching.pad_batch(df, pad_id=9, max_length=cap).collect()}
    assert rows["a"].input_ids == [5, 6, 7, 8][:width]
    assert rows["b"].input_ids == [5] + [9] * (width - 1)
    assert rows["b"].attention_mask == rows["b"].loss_mask == [1] + [0] * (width - 1)
    assert rows["c"].input_ids == [5, 6]
    assert rows["c"].batch_max_len == 2


def score_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "trajectory_id string, batch_id bigint, batch_max_len int, format string, loss_mask array<int>, "
        "teacher_values array<array<float>>, teacher_indices array<array<int>>",
    )


def test_pad_scores(spark):
    df = score_rows(spark, [("a", 0, 3, None, [1], [[-1.0, -2.0]], [[4, 5]]), ("b", 0, 3, None, [1], [[-1.0, -2.0]] * 5, [[4, 5]] * 5)])
    rows = {r.trajectory_id: r for r in batching.pad_scores(df, 2).collect()}
    assert rows["a"].teacher_values == [[-1.0, -2.0], [0.0, 0.0], [0.0, 0.0]]
    assert rows["a"].teacher_indices == [[4, 5], [0, 0], [0, 0]]
    assert rows["b"].teacher_values == [[-1.0, -2.0]] * 3


def test_batch_metadata(spark):
    v2, i2, v1, i1 = [[-1.0, -2.0]], [[4, 5]], [[-1.0]], [[4]]
    df = score_rows(
        spark,
        [
            ("a", 0, 1, "logits", [1], v2, i2),
            ("b", 0, 1, "logits", [1], v2, i2),
            ("c", 1, 1, "logits", [1], v2, i2),
            ("d", 1, 1, "logprobs", [1], v2, i2),
            ("e", 2, 1, "logits", [1], v2, i2),
            ("f", 2, 1, "logits", [1], v1, i1),
            ("g", 3, 1, "logits", [1], v2, i2),
            ("h", 3, 1, "logits", None, v2, i2),
        ],
    )
    meta = batching.batch_metadata(df)
    rows = {r.batch_id: r for r in meta.collect()}
    assert {b: r.is_uniform for b, r in rows.items()} == {0: True, 1: False, 2: False, 3: False}
    assert (rows[0].format, rows[0].top_k, rows[0].has_loss_mask) == ("logits", 2, True)
    assert batching.require_uniform(meta.filter("batch_id = 0")).first().format == "logits"
    with pytest.raises(PySparkException, match="batch 1 mixes"):
        batching.require_uniform(meta.filter("batch_id = 1")).collect()


def test_message_profile_of_nothing(spark):
    assert list(profile.message_profile(spark.createDataFrame([], "n_messages int")).first()) == [None] * 3


def test_funnel(spark):
    df = spark.createDataFrame(
        [(1, "submit", True), (1, "submit", False), (1, "submit", None), (0, "submit", True), (None, None, True)],
        "resolved int, exit_status string, fine boolean",
    )
    assert list(profile.funnel(df, F.col("fine")).first()) == [5, 3, 1]
    assert list(profile.funnel(df.limit(0), F.col("fine")).first()) == [0, 0, 0]


def test_running_loss_restarts_with_the_epoch(spark):
    rows = [(r, e, s, float(10 * e + s)) for r in (1, 2) for e in (0, 1) for s in range(7)]
    df = spark.createDataFrame(rows, "run_id int, epoch int, step int, loss double")
    got = {(r.run_id, r.epoch, r.step): r.avg_loss for r in profile.running_loss(df, 3).collect()}
    assert got == {(r, e, s): 10 * e + s / 2 for r in (1, 2) for e in (0, 1) for s in (2, 5)}


def test_new_best_is_strict(spark):
    losses = [3.0, 3.0, 2.0, 2.5, 2.0, 1.0]
    df = spark.createDataFrame([(1, e, v) for e, v in enumerate(losses)], "run_id int, epoch int, val_loss double")
    got = [r.is_best for r in profile.new_best(df).orderBy("epoch").collect()]
    assert got == [True, False, True, False, False, True]


def test_every_nth_epoch(spark):
    df = spark.createDataFrame([(e,) for e in range(7)], "epoch int")
    assert [r.epoch for r in profile.every_nth_epoch(df, 3).collect()] == [2, 5]
