"""Chunked batches against whole ones, and sums that do not depend on the order of rows."""

import random

import pytest
from pyspark.sql import functions as F

from test_score_store import SCHEMA, rows_of
from tracemill.operators import profile, divergence
from tracemill.plans.batches import chunked_batches, training_batches
from tracemill.session import fresh_path
from tracemill.sources.score_store import ScoreStore


@pytest.fixture(scope="module")
def world(spark):
    store = ScoreStore(spark, fresh_path(spark, "store"))
    lengths = {"a": 3000, "b": 5, "c": 1024, "d": 1025, "e": 2047}
    store.append(spark.createDataFrame([r for t, n in lengths.items() for r in rows_of([t], n)], SCHEMA))
    store.compact()
    slots = [("a", "train", 0, 0), ("b", "train", 0, 1), ("c", "train", 1, 0), ("d", "train", 1, 1), ("e", "val", 0, 0)]
    assignment = spark.createDataFrame(slots, "trajectory_id string, split string, batch_id long, slot int")
    return store, assignment


@pytest.mark.parametrize("max_tokens, max_length", [(8192, None), (2000, None), (8192, 1500)])
def test_flattened_chunks_equal_whole_batches(world, max_tokens, max_length):
    store, assignment = world
    common = {"max_tokens": max_tokens, "max_prompt": 16, "pad_id": -1, "max_length": max_length}
    whole = training_batches(store.positions(), store.headers(), assignment, 3, **common).collect()
    parts = chunked_batches(store.chunks(), store.headers(), assignment, 3, **common).collect()
    by = {}
    for r in sorted(parts, key=lambda r: r.chunk):
        assert r.n_tokens == len(r.input_ids) == len(r.teacher_values) and r.n_tokens + r.n_padding <= 1024
        by.setdefault((r.split, r.batch_id, r.slot), []).append(r)
    assert len(whole) == len(by) == 5
    for w in whole:
        rows = by[w.split, w.batch_id, w.slot]

        def flat(name, fill):
            return [x for r in rows for x in [*r[name], *[fill] * r.n_padding]]

        assert {r.batch_max_len for r in rows} == {w.batch_max_len}
        assert flat("input_ids", -1) == w.input_ids and flat("loss_mask", 0) == w.loss_mask
        assert flat("teacher_values", [0.0] * 3) == w.teacher_values
        assert flat("teacher_indices", [0] * 3) == w.teacher_indices
        assert (rows[0].prompt_ids, rows[0].prompt_mask) == (w.prompt_ids, w.prompt_mask)
        assert all(r.prompt_ids is None for r in rows[1:])


def test_chunks_are_not_moved(world):
    store, assignment = world
    rows = chunked_batches(store.chunks(), store.headers(), assignment, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin LeftOuter") if "SortMergeJoin LeftOuter" in plan else plan.index("SortMergeJoin") :]
    cache = join[join.rindex("Bucketed: true") - 3000 :]
    assert "Bucketed: true" in cache and "array<int>" not in plan.split("Exchange")[-1].split("Scan")[0]
    with pytest.raises(ValueError, match="1024"):
        chunked_batches(store.chunks(), store.headers(), assignment, 3, max_prompt=2000)


def test_exact_sums_do_not_depend_on_the_order(spark):
    dice = random.Random(9)
    rows = [(f"t{k % 3}", dice.choice([0, 1, 1]), dice.choice([1e9, 1e-9, 1.0]) * dice.random()) for k in range(3000)]
    rows += [("t0", 1, None)]
    found = set()
    for n in (1, 3, 7):
        dice.shuffle(rows)
        df = spark.createDataFrame(rows, "trajectory_id string, loss_mask int, kl double").repartition(n)
        sums = divergence.exact_sums(df).withColumn("batch_id", F.lit(0))
        found.add(tuple(divergence.exact_batch_loss(sums).collect()))
    assert len(found) == 1
    ((row,),) = found
    want = sum(kl for _, m, kl in rows if m and kl is not None) / sum(m for _, m, kl in rows if kl is not None)
    assert row.loss == pytest.approx(want, rel=1e-9)


def test_best_losses_do_not_depend_on_the_order(spark):
    """Two epochs with the same losses in another order are no improvement, in any partitioning."""
    losses = [0.1, 0.2, 0.3, 1e6, 1e-9, 0.7, None]
    rows = [("r", e, s, x) for e, order in enumerate((losses, losses[::-1], sorted(losses[:-1]))) for s, x in enumerate(order)]
    rows += [("none", 0, 0, None), ("wild", 0, 0, 1e300), ("wild", 1, 0, 2.0)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "run_id string, epoch int, step int, loss double").repartition(parts)
        got = {(r.run_id, r.epoch): (r.val_loss, r.is_best) for r in profile.new_best(profile.exact_losses(df)).collect()}
        assert [got["r", e][1] for e in range(3)] == [True, False, False]
        assert len({got["r", e][0] for e in range(3)}) == 1
        assert got["none", 0][0] is None
        assert got["wild", 0] == (1e300, True) and got["wild", 1] == (2.0, True)
