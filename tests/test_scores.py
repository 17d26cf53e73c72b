"""Top-k, scoring, divergence: against NumPy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import distributions
from tracemill.operators import divergence, scores

EPS = 1e-8


def log_softmax(z):
    z = z - z.max()
    return z - np.log(np.exp(z).sum())


def teacher_p(values, tag, temperature):
    v = np.asarray(values, dtype=float)
    w = np.exp(v / temperature) if tag == "logits" else np.exp(v)
    return w / w.sum()


def kl_of(values, ids, tag, student, temperature):
    p, q = teacher_p(values, tag, temperature), log_softmax(np.asarray(student) / temperature)[ids]
    return float(sum(a * (np.log(a) - b) for a, b in zip(p, q) if a > 0))


@pytest.fixture(scope="module")
def world():
    """Three trajectories of different length, 12 ids, 4 kept, mixed formats, holes in the scores."""
    rng = np.random.default_rng(3)
    rows = []
    for name, length, tag in (("a", 5, "logits"), ("b", 2500, "logprobs"), ("c", 40, None)):
        for pos in range(length):
            student = rng.normal(size=12) * 3
            ids = rng.permutation(12)[:4].tolist()
            values = np.sort(rng.normal(size=4) - 2)[::-1].astype(np.float32).astype(float).tolist()
            valid = pos > 0
            rows.append((name, pos, int(rng.random() < 0.6), tag, ids if valid else None, values if valid else None, student.tolist()))
    return rows


def frames(spark, world, sparse, temperature):
    teacher = spark.createDataFrame(
        [r[:6] for r in world],
        "trajectory_id string, pos int, loss_mask int, format string, top_ids array<int>, top_vals array<double>",
    )
    if not sparse:
        student = spark.createDataFrame([(r[0], r[1], r[6]) for r in world], "trajectory_id string, pos int, logits array<double>")
        return teacher, student
    rows = []
    for name, pos, _, _, _, _, z in world:
        scaled = np.asarray(z) / temperature
        rows.append((name, pos, float(scaled[0] - log_softmax(scaled)[0]), list(range(12)), scaled.tolist()))
    return teacher, spark.createDataFrame(rows, "trajectory_id string, pos int, lse double, ids array<int>, z array<double>")


@pytest.mark.parametrize("sparse", [True, False])
@pytest.mark.parametrize("temperature", [1.0, 2.0])
def test_divergence(spark, world, sparse, temperature):
    teacher, student = frames(spark, world, sparse, temperature)
    gathered = divergence.gather_student(teacher, student) if sparse else divergence.gather_dense(teacher, student, temperature)
    positions = divergence.position_kl(gathered, temperature)
    got = {(r.trajectory_id, r.pos): r.kl for r in positions.collect()}
    want = {
        (n, p): kl_of(v, i, tag or "logprobs", z, temperature) if i else None for n, p, _, tag, i, v, z in world
    }
    assert got.keys() == want.keys()
    for key, kl in want.items():
        assert got[key] == (None if kl is None else pytest.approx(kl, abs=1e-9))
        # The student's mass on the teacher's ids is at most 1.
        assert kl is None or got[key] >= -1e-12

    sums = {}
    for n, p, m, _, i, _, _ in world:
        if m and i:
            total, count = sums.get(n, (0.0, 0))
            sums[n] = (total + want[n, p], count + 1)
    per_sample = {n: t / (c + EPS) for n, (t, c) in sums.items()}
    sample_sums = divergence.sample_sums(positions)
    assert {r.trajectory_id: r.loss for r in divergence.sample_loss(sample_sums).collect()} == pytest.approx(per_sample)
    chunks = divergence.sample_loss(divergence.roll_up_chunks(divergence.chunk_sums(positions))).collect()
    assert {r.trajectory_id: r.loss for r in chunks} == pytest.approx(per_sample)
    assert {r.trajectory_id: r.n_chunks for r in chunks} == {"a": 1, "b": 3, "c": 1}
    token_mean = sum(t for t, _ in sums.values()) / (sum(c for _, c in sums.values()) + EPS)
    assert divergence.masked_mean(positions).first().loss == pytest.approx(token_mean)
    batch = sample_sums.withColumn("batch_id", F.lit(0))
    assert divergence.batch_loss(batch).first().loss == pytest.approx(token_mean)
    macro = divergence.batch_mean_of_samples(batch, accumulation_steps=2).first()
    assert macro.loss == pytest.approx(sum(per_sample.values()) / 3 / 2)
    assert abs(macro.loss * 2 - token_mean) > 1e-3


def test_kl_is_zero_for_equal_distributions_and_handles_zero_mass(spark):
    z = [0.5, -1.0, 2.0]
    logp = log_softmax(np.asarray(z)).tolist()
    df = spark.createDataFrame(
        [
            ("full", 0, 1, "logprobs", [0, 1, 2], logp, logp, 0),
            ("none", 0, 1, "logprobs", [0, 1], [0.0, float("-inf")], [-1.5, -2.0], 0),
        ],
        "trajectory_id string, pos int, loss_mask int, format string, top_ids array<int>, top_vals array<double>, "
        "student_logp array<double>, n_missing int",
    )
    got = {r.trajectory_id: r.kl for r in divergence.position_kl(df).collect()}
    assert got["full"] == pytest.approx(0.0, abs=1e-12)
    assert got["none"] == pytest.approx(1.5)


def test_all_masked_gives_zero(spark, world):
    teacher, student = frames(spark, world, False, 1.0)
    positions = divergence.position_kl(divergence.gather_dense(teacher.withColumn("loss_mask", F.lit(0)), student))
    assert {r.loss for r in divergence.sample_loss(divergence.sample_sums(positions)).collect()} == {0.0}


def test_missing_student_scores(spark):
    teacher = spark.createDataFrame(
        [("t", 0, 0, None, [1, 5], [-1.0, -2.0]), ("t", 1, 0, None, [1], [-1.0])],
        "trajectory_id string, pos int, loss_mask int, format string, top_ids array<int>, top_vals array<double>",
    )
    student = spark.createDataFrame([("t", 0, 0.0, [1, 2], [-1.0, -2.0])], "trajectory_id string, pos int, lse double, ids array<int>, z array<double>")
    gathered = divergence.gather_student(teacher, student)
    assert {r.pos: r.n_missing for r in gathered.collect()} == {0: 1, 1: 1}
    assert [r.kl for r in divergence.position_kl(gathered).collect()] == [None, None]
    with pytest.raises(PySparkException, match="no student score for trajectory t"):
        divergence.position_kl(gathered.withColumn("loss_mask", F.lit(1))).collect()


def test_shift(spark):
    teacher = spark.createDataFrame([("t", 1, 1, None, [0], [0.0])], "trajectory_id string, pos int, loss_mask int, format string, top_ids array<int>, top_vals array<double>")
    student = spark.createDataFrame([("t", p, 0.0, [0], [-float(p + 1)]) for p in (0, 1)], "trajectory_id string, pos int, lse double, ids array<int>, z array<double>")
    kl = [divergence.position_kl(divergence.gather_student(teacher, student, shift=s)).first().kl for s in (0, 1)]
    assert kl == pytest.approx([2.0, 1.0])


def test_dense_teacher(spark, world):
    rng = np.random.default_rng(5)
    teacher_z = {(r[0], r[1]): rng.normal(size=12) for r in world}
    teacher = spark.createDataFrame(
        [(n, p, m, teacher_z[n, p].tolist()) for n, p, m, *_ in world], "trajectory_id string, pos int, loss_mask int, logits array<double>"
    )
    student = spark.createDataFrame([(r[0], r[1], r[6]) for r in world], "trajectory_id string, pos int, logits array<double>")
    got = {r.trajectory_id: r.loss for r in divergence.dense_loss(teacher, student, 3, 2.0).collect()}
    want = {}
    for n, p, m, *_, z in world:
        if m:
            ids = np.argsort(-teacher_z[n, p])[:3]
            value = kl_of(teacher_z[n, p][ids].astype(np.float32), ids, "logits", z, 2.0)
            total, count = want.get(n, (0.0, 0))
            want[n] = (total + value, count + 1)
    assert got == pytest.approx({n: t / (c + EPS) for n, (t, c) in want.items()}, rel=1e-6)


def test_mean_of_batches(spark):
    df = spark.createDataFrame([("v", 1.0), ("v", 2.0), ("v", 6.0)], "split string, loss double")
    assert divergence.mean_of_batches(df, ["split"]).first().avg_loss == 3.0
    assert divergence.mean_of_batches(df.limit(0)).first().avg_loss == 0.0


def test_top_k_ties_and_short_rows(spark):
    dense = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],), ([2.0],), ([],)], "z array<double>")
    got = [[(e.val, e.id) for e in r.k] for r in dense.select(scores.top_k_dense(F.col("z"), 3).alias("k")).collect()]
    assert got == [[(3.0, 1), (3.0, 2), (1.0, 0)], [(2.0, 0)], []]
    maps = spark.createDataFrame([({7: -1.0, 3: -1.0, 5: -0.5},), (None,), ({},)], "m map<int,double>")
    got = [None if r.k is None else [e.id for e in r.k] for r in maps.select(scores.top_k_map(F.col("m"), 2).alias("k")).collect()]
    assert got == [[5, 3], None, []]
    rows = spark.createDataFrame([("t", 0, i, s) for i, s in enumerate([1.0, 3.0, 3.0, -1.0])], "trajectory_id string, pos int, token_id int, score double")
    assert [(r.rank, r.token_id) for r in scores.top_k_rows(rows, 3).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 0)]


def test_zero_fill_is_probability_one(spark):
    df = spark.createDataFrame([("t", 1, None, [3], [-2.0]), ("u", 1, None, None, None)], "trajectory_id string, loss_mask int, format string, top_ids array<int>, top_vals array<float>")
    rows = {r.trajectory_id: r for r in scores.zero_fill(df, 3).collect()}
    assert (rows["t"].top_ids, rows["t"].top_vals) == ([3, 0, 0], [-2.0, 0.0, 0.0])
    assert rows["u"].top_ids is None


def samples(spark, n=20):
    return spark.createDataFrame(
        [(f"t{i}", [i, i + 1, i + 2], [0, 1, 1], 1) for i in range(n)],
        "trajectory_id string, input_ids array<int>, loss_mask array<int>, prompt_boundary int",
    )


def test_scorer_failures_stay_with_their_row(spark):
    def make():
        def score(batch):
            assert len(batch) <= 4
            if any(ids[0] % 7 == 3 for ids in batch):
                raise RuntimeError("no")
            return [[None, *({t: -1.0} for t in ids[1:])] for ids in batch]

        return score

    scored = scores.score_with(samples(spark), make, batch_size=4)
    good, failed = scores.split_by_status(scored)
    assert sorted(r.trajectory_id for r in failed.collect()) == ["t10", "t17", "t3"]
    assert {r.error for r in failed.collect()} == {"RuntimeError: no"}
    rows = scores.cache_positions(good, 2).collect()
    assert len(rows) == 17 * 3
    for r in rows:
        assert (r.is_valid, r.loss_mask) == ((0, 0) if r.pos == 0 else (1, 1))
        assert r.top_ids == (None if r.pos == 0 else [r.token_id])


def test_dense_scorer(spark):
    def make():
        import numpy as np

        return lambda batch: [np.asarray([[t % 3, 1.0, 2.0, 2.0] for t in ids]) for ids in batch]

    scored = scores.score_with(samples(spark, 4), make, top_k=2, partitions=2)
    assert all(len(r.scores) == 2 for r in scored.collect())
    rows = scores.cache_positions(scores.split_by_status(scored)[0], 2, "logits").collect()
    assert {tuple(r.top_ids) for r in rows if r.token_id % 3 == 2} == {(0, 2)}
    assert {tuple(r.top_ids) for r in rows if r.token_id % 3 != 2} == {(2, 3)}
    assert {r.format for r in rows} == {"logits"}


def test_kl_of_a_batch_of_uneven_rows(spark):
    """Rows without scores, with NULLs and of uneven length beside each other; no array function per pair."""
    nan, low = float("nan"), float("-inf")
    cases = [
        (0, [0.0, low], [-1.5, None], 1.5),
        (1, [0.0, -1.0], [-1.0, None], None),
        (2, [], [], None),
        (3, None, [-1.0], None),
        (4, [-1.0], None, None),
        (5, [0.0, 0.0], [-1.0], None),
        (6, [0.0], [-1.0, -2.0], None),
        (7, [None, 0.0], [-1.0, -1.0], None),
        (8, [0.0, nan], [-1.0, -1.0], nan),
        (9, [3.0], [-2.0], 2.0),
        (10, [0.0, low], [-1.5], 1.5),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], "i int, u array<double>, q array<double>").coalesce(1)
    result = df.select("i", distributions.sparse_kl(F.col("u"), F.col("q")).alias("kl"))
    got = {r.i: r.kl for r in result.collect()}
    for i, _, _, want in cases:
        assert got[i] == (None if want is None else pytest.approx(want, nan_ok=True)), i
    assert "lambda" not in result._jdf.queryExecution().optimizedPlan().toString()
