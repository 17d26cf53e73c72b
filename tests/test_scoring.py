"""Partial selection and balanced scoring against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tracemill.operators import scoring, selection
from tracemill.plans.score import build_store
from tracemill.session import fresh_path
from tracemill.sources.score_store import ScoreStore


def ranked(row, k):
    real = [(-v, i) for i, v in enumerate(row) if v is not None and not np.isnan(v)]
    rest = [(0, i) for i, v in enumerate(row) if v is None or np.isnan(v)]
    return [i for _, i in sorted(real) + rest][:k]


def test_partial_selection(spark):
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 5, 40).astype(float).tolist() for _ in range(50)]
    rows += [rng.normal(size=n).tolist() for n in (1, 3, 3, 200)] + [[], None, [float("nan"), 1.0, float("-inf"), None, 1.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, logits array<double>").repartition(3)
    best = selection.with_top_k_partial(df, "logits", 7)
    for r in best.collect():
        if rows[r.i] is None:
            assert r.top_ids is None and r.top_vals is None
            continue
        assert r.top_ids == ranked(rows[r.i], 7)
        got = [rows[r.i][i] for i in r.top_ids]
        assert np.allclose(r.top_vals, [np.nan if v is None else np.float32(v) for v in got], equal_nan=True)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "ArrowEvalPython" in plan


def test_selection_in_blocks(monkeypatch, spark):
    monkeypatch.setattr(selection, "_BLOCK_VALUES", 50)
    scores = np.random.default_rng(1).integers(0, 9, (30, 20)).astype(float)
    ids, vals = selection.select_rows(scores, 6)
    assert ids.tolist() == [ranked(r, 6) for r in scores.tolist()]
    assert (vals == np.take_along_axis(scores, ids, axis=1)).all()


def test_micro_batches_keep_their_bound():
    rng = np.random.default_rng(8)
    lengths = rng.integers(0, 900, 300).tolist() + [5000]
    batches = list(scoring.micro_batches(lengths, 2000, 8))
    assert sorted(k for b in batches for k in b) == list(range(301))
    for b in batches:
        longest = max(lengths[k] for k in b)
        assert len(b) <= 8 and (len(b) * longest <= 2000 or len(b) == 1)
    assert list(scoring.micro_batches([], 10, 2)) == []


def samples(spark, lengths):
    rows = [(f"t{k}", list(range(n)), [1] * n, n // 2) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "trajectory_id string, input_ids array<int>, loss_mask array<int>, prompt_boundary int")


def test_tasks_have_equal_tokens(spark):
    lengths = np.random.default_rng(6).integers(1, 400, 3000).tolist()
    dealt = scoring.balanced(samples(spark, lengths), 10)
    per_task = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("input_ids")).alias("n")).collect()
    share = sum(lengths) / 10
    assert len(per_task) == 10 and all(abs(r.n - share) <= 400 for r in per_task)
    assert dealt.count() == 3000 and scoring.balanced(samples(spark, []), 4).count() == 0


def awkward_scorer():
    """Dense scores for every other sequence, maps for the rest; odd answers for some lengths."""

    def make():
        def score(batch):
            assert len(batch) * max(map(len, batch)) <= 300 or len(batch) == 1
            if any(len(ids) == 13 for ids in batch):
                raise RuntimeError("thirteen")
            out = []
            for ids in batch:
                dense = np.array([[(i * 7 + v * 3) % 5 for v in range(6)] for i in ids], dtype=np.float32).reshape(len(ids), 6)
                if len(ids) == 21:
                    out.append(None)
                elif len(ids) == 22:
                    out.append(dense[:-1])
                elif len(ids) % 2:
                    out.append([None if i == 0 else {v: float(x) for v, x in enumerate(row)} for i, row in enumerate(dense)])
                else:
                    out.append(dense)
            return out

        return score

    return make


def test_scores_and_failures(spark):
    lengths = [*range(0, 60), 13, 500, 2100]
    scored = scoring.score_arrays(samples(spark, lengths), awkward_scorer(), max_tokens=300, top_k=3, partitions=3)
    by = {}
    for r in scored.collect():
        by.setdefault(r.trajectory_id, []).append(r)
    assert len(by) == len(lengths)
    for k, n in enumerate(lengths):
        rows = by[f"t{k}"]
        if n in (0, 13, 21, 22):
            assert [r.status for r in rows] == ["error"] and rows[0].error and rows[0].seq_len == n
            continue
        assert [r.pos for r in rows] == list(range(n)) and {r.status for r in rows} == {"ok"}
        for r in rows:
            if n % 2 and r.pos == 0:
                assert r.top_ids is None
                continue
            row = [(r.pos * 7 + v * 3) % 5 for v in range(6)]
            assert r.top_ids == ranked(row, 3) and r.top_vals == [row[i] for i in r.top_ids]


def test_store_is_built_in_one_pass_and_resumed(spark, monkeypatch):
    messages = spark.createDataFrame(
        [(f"c{k}", m, "user" if m % 2 == 0 else "assistant", "word " * (20 + k)) for k in range(6) for m in range(4)],
        "trajectory_id string, msg_idx int, role string, content string",
    )

    def encoder():
        return lambda texts: [(list(range(len(t) // 5)), [(5 * i, 5 * i + 5) for i in range(len(t) // 5)]) for t in texts]

    def scorer(limit):
        def make():
            def score(batch):
                if any(len(ids) > limit for ids in batch):
                    raise ValueError("too long")
                return [[{i: -1.0, i + 1: -2.0} for i in ids] for ids in batch]

            return score

        return make

    store = ScoreStore(spark, fresh_path(spark, "store"))
    first = build_store(messages, None, store, scorer(100), run_id="one", make_encoder=encoder)
    done = store.headers().count()
    assert 0 < done < 6 and store.quarantined().count() == 6 - done
    build_store(messages, None, store, scorer(1000), run_id="two", make_encoder=encoder)
    assert store.headers().count() == 6 and store.quarantined().where("attempt > 1").count() == 0
    assert store.headers(first).count() == done
    # Nothing is left: an empty run changes nothing.
    build_store(messages, None, store, scorer(1), run_id="three", make_encoder=encoder)
    assert store.headers().count() == 6 and "map" not in str(store.positions().schema).lower()

