"""Sources and sinks, resume, and whole jobs."""

import io

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracemill import fixtures as fx
from tracemill.operators import filters, render, tokens
from tracemill.plans.evaluate import assign_epoch, evaluate
from tracemill.plans.prepare import prepare_gold, tokenize_trajectories
from tracemill.plans.score import build_cache
from tracemill.schemas import TRAJECTORIES
from tracemill.sources import choose, npz, score_cache, tokenized
from tracemill.sources import trajectories as stored
from test_rendering import TOOLS, frame, message

SF = "/root/testdata/sf0.001"
LONG_ENOUGH = {
    f"t{i}": [message("user", f"question {i} " * 6), message("assistant", f"answer {i} " * (i + 8))] for i in range(12)
}


@pytest.fixture(scope="module")
def messages(spark):
    return render.explode_messages(frame(spark, **LONG_ENOUGH)).cache()


@pytest.fixture(scope="module")
def dictionary(spark, messages):
    return tokens.token_dictionary(tokens.explode_tokens(render.locate_parts(messages), offsets=False))


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_trajectories_round_trip(spark, tmp_path, file_format):
    df = frame(spark, tools=TOOLS, **LONG_ENOUGH)
    df.write.format(file_format).save(str(tmp_path / "raw"))
    loaded = stored.load_trajectories(spark, str(tmp_path / "raw"), file_format)
    assert loaded.schema == TRAJECTORIES
    key = lambda r: r.trajectory_id
    assert sorted(loaded.collect(), key=key) == sorted(df.collect(), key=key)


def test_missing_sources(spark, tmp_path):
    for load in (
        lambda p: stored.load_trajectories(spark, p),
        lambda p: stored.load_gold(spark, p),
        lambda p: score_cache.read_cache(spark, p),
    ):
        with pytest.raises(FileNotFoundError):
            load(str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        npz.read_npz_cache(spark, str(tmp_path))
    with pytest.raises(ValueError):
        stored.load_trajectories(spark, str(tmp_path), "csv")


def test_prepare_gold(spark, tmp_path):
    df = fx.trajectories(spark, SF)
    row = prepare_gold(df, str(tmp_path / "gold"), max_samples=5).first()
    kept = stored.load_gold(spark, str(tmp_path / "gold"))
    want = sorted(r.trajectory_id for r in filters.gold(df).collect())[:5]
    assert sorted(r.trajectory_id for r in kept.collect()) == want
    assert row.max_messages == kept.agg(F.max(F.size("trajectory"))).first()[0]


def test_only_needed_fields_are_read(spark, tmp_path):
    frame(spark, **LONG_ENOUGH).write.parquet(str(tmp_path / "gold"))
    loaded = stored.load_gold(spark, str(tmp_path / "gold"))
    plan = filters.gold(loaded).select("trajectory.role")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<trajectory:array<struct<role:string>>" in plan
    assert "PushedFilters: [IsNotNull(resolved), IsNotNull(exit_status), EqualTo(resolved,1)" in plan


def test_resume(spark, tmp_path, messages, dictionary):
    path = str(tmp_path / "cache")
    half = messages.filter(F.col("trajectory_id") < "t2")
    build_cache(half, dictionary, path, fx.echo_scorer(), run_id="one", top_k=2)
    build_cache(messages, dictionary, path, fx.echo_scorer(), run_id="two", top_k=2)
    before = sorted(score_cache.read_headers(spark, path).collect())
    build_cache(messages, dictionary, path, fx.echo_scorer(), run_id="three", top_k=2)
    assert sorted(score_cache.read_headers(spark, path).collect()) == before
    assert {r.trajectory_id: r.run_id for r in before} == {k: "one" if k < "t2" else "two" for k in LONG_ENOUGH}
    rows = score_cache.read_cache(spark, path)
    assert rows.groupBy("trajectory_id", "pos").count().filter("count > 1").isEmpty()
    assert rows.count() == sum(r.seq_len for r in before)
    summary = score_cache.cache_summary(spark, path).first()
    assert summary.n_trajectories == 12 and summary.n_files > 0 and summary.total_gb > 0


def test_unfinished_run_is_ignored(spark, tmp_path, messages, dictionary):
    path = str(tmp_path / "cache")
    build_cache(messages.filter("trajectory_id = 't1'"), dictionary, path, fx.echo_scorer(), run_id="good", top_k=2)
    good = score_cache.read_cache(spark, path)
    n = good.count()
    good.drop("run_id").withColumn("trajectory_id", F.lit("t2")).write.partitionBy("format").parquet(f"{path}/positions/run_id=dead")
    assert score_cache.read_cache(spark, path).count() == n
    failed = build_cache(messages, dictionary, path, fx.echo_scorer(), run_id="next", top_k=2)
    assert failed.isEmpty()
    rows = score_cache.read_cache(spark, path)
    assert rows.select("trajectory_id").distinct().count() == 12
    assert rows.filter("run_id = 'dead'").isEmpty()


def test_failures_are_returned_and_tried_again(spark, tmp_path, messages, dictionary):
    path = str(tmp_path / "cache")
    failed = build_cache(messages, dictionary, path, fx.echo_scorer(longest=70), top_k=2, partitions=3)
    n_failed = failed.count()
    assert 0 < n_failed < 12
    assert build_cache(messages, dictionary, path, fx.echo_scorer(), top_k=2).isEmpty()
    assert score_cache.read_headers(spark, path).count() == 12


def test_cache_without_good_rows(spark, tmp_path, messages, dictionary):
    path = str(tmp_path / "cache")
    assert build_cache(messages, dictionary, path, fx.echo_scorer(longest=1), top_k=2).count() == 12
    with pytest.raises(ValueError, match="no cached trajectories"):
        score_cache.read_cache(spark, path)


def test_format_is_a_partition(spark, tmp_path, messages, dictionary):
    path = str(tmp_path / "cache")
    build_cache(messages.filter("trajectory_id < 't2'"), dictionary, path, fx.echo_scorer(), top_k=2)
    build_cache(messages, dictionary, path, fx.echo_scorer(), top_k=2, score_format="logits")
    formats = {r.format: r["count"] for r in score_cache.read_headers(spark, path).groupBy("format").count().collect()}
    assert formats == {"logprobs": 4, "logits": 8}
    only = score_cache.read_cache(spark, path, "logits")
    assert only.select("trajectory_id").distinct().count() == 8
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "(format" in plan


def archive(path, **arrays):
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    path.write_bytes(buffer.getvalue())


def test_npz_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 2100
    full = dict(
        values=rng.normal(size=(n, 3)).astype(np.float16),
        indices=rng.integers(0, 99, (n, 3)).astype(np.int32),
        input_ids=rng.integers(0, 99, n).astype(np.int32),
        format=np.array(["logprobs"]),
        loss_mask=rng.integers(0, 2, n).astype(np.int32),
        prompt_boundary=np.array([17], dtype=np.int32),
    )
    old = dict(values=np.ones((2, 1), np.float16), indices=np.zeros((2, 1), np.int32), input_ids=np.array([[4, 5, 6]], np.int32), format=np.array(["logits"]))
    archive(tmp_path / "trajectory_000001.npz", **full)
    archive(tmp_path / "trajectory_000002.npz", **old)
    archive(tmp_path / "other.npz", **old)
    rows = sorted(npz.read_npz_cache(spark, str(tmp_path)).collect(), key=lambda r: (r.trajectory_id, r.pos))
    first, second = rows[:n], rows[n:]
    assert {r.trajectory_id for r in first} == {"trajectory_000001"}
    assert [r.pos for r in first] == list(range(n))
    assert [r.chunk for r in first] == [p // 1024 for p in range(n)]
    assert [r.token_id for r in first] == full["input_ids"].tolist()
    assert [r.loss_mask for r in first] == full["loss_mask"].tolist()
    assert [r.top_ids for r in first] == full["indices"].tolist()
    assert [r.top_vals for r in first] == full["values"].astype(np.float32).tolist()
    assert {(r.format, r.prompt_boundary) for r in first} == {("logprobs", 17)}
    assert [(r.token_id, r.loss_mask, r.prompt_boundary, r.format, r.top_ids) for r in second] == [
        (4, None, None, "logits", [0]),
        (5, None, None, "logits", [0]),
        (6, None, None, "logits", None),
    ]


def test_imported_archives_in_the_cache(spark, tmp_path):
    """No stored mask: all positions count. A short mask: the rest does not."""
    values, indices, ids = np.zeros((3, 1), np.float16), np.zeros((3, 1), np.int32), np.array([[4, 5, 6]], np.int32)
    archive(tmp_path / "trajectory_1.npz", values=values, indices=indices, input_ids=ids)
    archive(tmp_path / "trajectory_2.npz", values=values, indices=indices, input_ids=ids, loss_mask=np.array([1], np.int32))
    path = str(tmp_path / "cache")
    score_cache.write_cache(tokens.valid_mask(npz.read_npz_cache(spark, str(tmp_path))), path)
    headers = {r.trajectory_id: (r.has_loss_mask, r.format, r.seq_len) for r in score_cache.read_headers(spark, path).collect()}
    assert headers == {"trajectory_1": (False, "logprobs", 3), "trajectory_2": (True, "logprobs", 3)}
    assert score_cache.cache_summary(spark, path).first().n_without_mask == 1
    cache = score_cache.read_cache(spark, path, "logprobs")
    # ln q = -1 at the first position, -2 and -3 after it.
    student = cache.select("trajectory_id", "pos", F.lit(0.0).alias("lse"), F.array(F.lit(0)).alias("ids"), F.array(-(F.col("pos") + 1.0)).alias("z"))
    assignment = spark.createDataFrame([("trajectory_1", "train", 0), ("trajectory_2", "val", 0)], "trajectory_id string, split string, batch_id int")
    losses = {r.split: r.avg_loss for r in evaluate(cache, student, assignment).collect()}
    assert losses == pytest.approx({"train": 2.0, "val": 1.0}, abs=1e-6)


def test_tokenized_round_trip_and_choice(spark, tmp_path, messages, dictionary):
    df = frame(spark, tools=TOOLS * 4, short=[message("user", "x")], **LONG_ENOUGH)
    calls = []

    def raw():
        calls.append(1)
        return tokenize_trajectories(df, minimum_tokens=40, max_tokens=60)

    def pick():
        return choose.choose_source(
            spark, cache_path=str(tmp_path / "cache"), tokenized_path=str(tmp_path / "tokens"), tokenize_raw=raw
        )

    name, rows = pick()
    assert name == "raw" and {r.trajectory_id for r in rows.collect()} == {"tools", *LONG_ENOUGH}
    assert {(r.instance_id, r.repo) for r in rows.collect()} == {("", "")}
    assert all(40 <= len(r.input_ids) <= 60 and r.attention_mask == [1] * len(r.input_ids) for r in rows.collect())
    name, again = pick()
    assert name == "tokenized" and len(calls) == 1
    key = lambda r: r.trajectory_id
    assert sorted(again.collect(), key=key) == sorted(rows.collect(), key=key)
    plan = tokenized.read_tokenized(spark, str(tmp_path / "tokens")).select("trajectory_id")
    assert "ReadSchema: struct<trajectory_id:string>" in plan._jdf.queryExecution().executedPlan().toString()
    build_cache(messages, dictionary, str(tmp_path / "cache"), fx.echo_scorer(), top_k=2)
    assert pick()[0] == "cache"


def test_empty_cache_folder_is_an_error(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    with pytest.raises(FileNotFoundError):
        choose.choose_source(spark, cache_path=str(tmp_path / "cache"), tokenized_path=None, tokenize_raw=None)


def test_evaluate_uses_the_cache(spark, tmp_path, messages, dictionary):
    """Student equal to the teacher's renormalised scores: every loss is 0."""
    path = str(tmp_path / "cache")
    build_cache(messages, dictionary, path, fx.echo_scorer(), top_k=3)
    cache = score_cache.read_cache(spark, path)
    student = cache.filter(F.col("top_ids").isNotNull()).select(
        "trajectory_id",
        "pos",
        F.col("top_ids").alias("ids"),
        F.col("top_vals").cast("array<double>").alias("z"),
        F.aggregate("top_vals", F.lit(0.0), lambda a, v: a + F.exp(v.cast("double")), lambda a: F.ln(a)).alias("lse"),
    )
    ids = score_cache.read_headers(spark, path).select("trajectory_id")
    result = {r.split: r for r in evaluate(cache, student, assign_epoch(ids, 0, 4)).collect()}
    assert {s: r.n_batches for s, r in result.items()} == {"train": 3, "val": 1}
    assert all(r.avg_loss == pytest.approx(0.0, abs=1e-9) for r in result.values())
    worse = evaluate(cache, student.withColumn("lse", F.col("lse") + 1), assign_epoch(ids, 0, 4)).collect()
    assert all(r.avg_loss == pytest.approx(1.0, abs=1e-6) for r in worse)


@pytest.mark.parametrize(
    "sf, counts", [("0.001", (20, 9, 9, 4)), ("0.01", (100, 38, 30, 2))]
)
def test_given_tables(spark, sf, counts):
    sf_dir = f"/root/testdata/sf{sf}"
    heads = fx.headers(spark, sf_dir)
    bounds = render.prompt_boundary(render.locate_parts(fx.messages(spark, sf_dir)))
    assert heads.count() == counts[0]
    assert heads.filter("resolved is not null").count() == counts[1]
    assert filters.gold(heads).count() == counts[2]
    assert bounds.filter("prompt_boundary = n_tokens").count() == counts[3]


def test_count_scores(spark):
    from tracemill.operators.divergence import gather_student, position_kl, sample_loss, sample_sums

    teacher, student = fx.count_scores(spark, "/root/testdata/sf0.01")
    losses = {r.trajectory_id: r for r in sample_loss(sample_sums(position_kl(gather_student(teacher, student)))).collect()}
    assert len(losses) == 100
    # The masks are those of the gold conversations alone; the counts now come from all.
    for key, n_masked in (("0", 778), ("1", 1024), ("4", 604)):
        assert losses[key].n_masked == n_masked
    assert losses["1"].loss == pytest.approx(2.067211, abs=1e-6)


def test_a_format_in_one_file_that_all_tasks_wrote(spark, tmp_path):
    n, path = 6000, str(tmp_path / "cache")
    rows = spark.range(0, n, 1, 6).selectExpr(
        "concat('t', id % 40) AS trajectory_id",
        "cast(id / 40 AS int) AS pos",
        "0 AS chunk",
        "cast(id AS int) AS token_id",
        "1 AS loss_mask",
        "1 AS is_valid",
        "array(cast(id AS int), 7) AS top_ids",
        "if(id % 3 = 0, NULL, array(cast(id AS float), 0.5f)) AS top_vals",
        "if(id % 40 % 2 = 0, 'logits', NULL) AS format",
    )
    score_cache.write_cache(rows, path, "run", one_file=True)
    for folder in ("logits", "logprobs"):
        (file,) = (tmp_path / "cache/positions/run_id=run" / f"format={folder}").glob("*.parquet")
        assert pq.ParquetFile(file).num_row_groups == 6
    assert not (tmp_path / "cache/parts/run").exists()
    got = score_cache.read_cache(spark, path).selectExpr("token_id AS id", "trajectory_id", "pos", "format", "top_ids", "top_vals")
    want = rows.selectExpr("token_id AS id", "trajectory_id", "pos", "coalesce(format, 'logprobs')", "top_ids", "top_vals")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert score_cache.cache_summary(spark, path).first().n_files == 2
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
