"""The versioned score store: versions, compaction, quarantine, and plans that leave it where it lies."""

import re

import pytest
from pyspark.sql import functions as F

from tracemill.operators import divergence
from tracemill.plans.evaluate import evaluate, evaluate_store
from tracemill.session import fresh_path
from tracemill.sources import manifest, score_store
from tracemill.sources.clustered import write_clustered
from tracemill.sources.score_store import RepeatedTrajectory, ScoreStore

SCHEMA = (
    "trajectory_id string, chunk int, pos int, token_id int, loss_mask int, is_valid int, top_ids array<int>, "
    "top_vals array<float>, format string, prompt_boundary int"
)


def rows_of(ids, length=2500, base=0):
    return [
        (t, p // 1024, p, base + p % 7, p % 2, int(p > 0), [1, 2] if p else None, [-0.5, -1.0 - p % 3] if p else None, None, 3)
        for t in ids
        for p in range(length)
    ]


@pytest.fixture
def store(spark):
    return ScoreStore(spark, fresh_path(spark, "store"))


def ids_of(df):
    return sorted((r.trajectory_id, r.run_id) for r in df.select("trajectory_id", "run_id").collect())


def test_versions_and_compaction(spark, store):
    assert store.snapshot().version == 0 and store.leftovers() == []
    store.append(spark.createDataFrame(rows_of("ab"), SCHEMA), "one")
    store.append(spark.createDataFrame(rows_of("bc", base=100), SCHEMA), "two")
    spark.createDataFrame(rows_of("d"), SCHEMA).write.parquet(f"{store.path}/runs/dead/positions")
    before = store.snapshot()
    assert before.runs == ("one", "two") and before.version == 2
    want = [("a", "one"), ("b", "one"), ("c", "two")]
    assert ids_of(store.headers()) == want
    with pytest.raises(ValueError, match="2 runs"):
        store.chunks()
    after = store.compact(buckets=3)
    assert after.runs == () and after.buckets == 3 and store.compact() == after
    assert ids_of(store.headers()) == want
    order = ["trajectory_id", "pos"]
    old, new = (sorted(map(tuple, store.positions(v).select(*order, "token_id", "top_ids").collect())) for v in (before, after))
    assert old == new and len(old) == 7500
    # One run more beside the generation; its copy of a does not count.
    store.append(spark.createDataFrame(rows_of("ad", base=50), SCHEMA), "three")
    assert ids_of(store.headers()) == [*want, ("d", "three")]
    assert store.positions().where("trajectory_id = 'a' AND token_id >= 50").count() == 0
    last = store.compact()
    assert store.positions(last).count() == 10_000 and last.buckets == 3
    # Merged runs and the run that died are left over.
    assert {p.rsplit("/", 1)[1] for p in store.leftovers()} == {"one", "two", "three", "dead", after.generation}


def test_compaction_shuffles_positions_once(spark, store, monkeypatch):
    store.append(spark.createDataFrame(rows_of("abcd"), SCHEMA), "one")
    plans = []

    def write(df, keys, *, partitioned=False, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange") + (not partitioned))
        return write_clustered(df, keys, partitioned=partitioned, **options)

    monkeypatch.setattr(score_store, "write_clustered", write)
    after = store.compact(buckets=3)
    assert plans == [1]
    chunks = store.chunks(after)
    # Each bucket is one file, written by one task, and holds whole chunks.
    assert len(chunks.inputFiles()) <= 3 and chunks.count() == 12
    rows = chunks.selectExpr("trajectory_id", "chunk", "rows.pos as p").collect()
    assert {(r.trajectory_id, r.chunk): r.p for r in rows} == {
        (t, c): list(range(c * 1024, min(2500, c * 1024 + 1024))) for t in "abcd" for c in range(3)
    }


def test_buckets_grow_with_the_scores(spark, store, monkeypatch):
    monkeypatch.setattr(score_store, "BUCKET_ENTRIES", 1000, raising=False)
    store.append(spark.createDataFrame(rows_of("abcd"), SCHEMA), "one")
    # 10,000 positions, 9,996 of them with two scores each.
    after = store.compact()
    assert after.buckets == 30 and store.positions(after).count() == 10_000
    store.append(spark.createDataFrame(rows_of("ef"), SCHEMA), "two")
    assert store.compact().buckets == 45


def test_a_commit_is_refused_where_another_was_first(spark):
    folder = fresh_path(spark, "manifest")
    assert manifest.commit(spark, folder, 1, {"runs": ["é"]})
    assert not manifest.commit(spark, folder, 1, {"runs": []})
    assert manifest.latest(spark, folder) == 1 and manifest.read(spark, folder, 1) == {"runs": ["é"]}
    assert manifest.child_names(spark, folder) == ["v0000000001.json"]


def test_runs_committed_while_merging_stay(spark, store, monkeypatch):
    store.append(spark.createDataFrame(rows_of("a", 10), SCHEMA), "one")
    positions = store.positions

    def slow(snapshot):
        ScoreStore(spark, store.path).append(spark.createDataFrame(rows_of("b", 10), SCHEMA), "late")
        return positions(snapshot)

    monkeypatch.setattr(store, "positions", slow)
    after = store.compact()
    assert after.runs == ("late",) and ids_of(store.headers()) == [("a", "one"), ("b", "late")]


def test_repeated_and_null_ids_are_refused(spark, store):
    for bad in (rows_of("ab", 20) + rows_of("a", 20), rows_of([None], 5)):
        with pytest.raises(RepeatedTrajectory):
            store.append(spark.createDataFrame(bad, SCHEMA))
    assert store.snapshot().version == 0 and len(store.leftovers()) == 2


def test_quarantine_counts_attempts(spark, store):
    failed = spark.createDataFrame([("a", "too long"), ("b", "no scores")], "trajectory_id string, error string")
    store.quarantine(failed, "one")
    store.quarantine(failed.where("trajectory_id = 'a'"), "two")
    got = {(r.trajectory_id, r.attempt, r.run_id) for r in store.quarantined().collect()}
    assert got == {("a", 1, "one"), ("b", 1, "one"), ("a", 2, "two")}


def students(spark, positions):
    """Students with ids in another order, and gaps in the positions that count for nothing."""
    rows = positions.where("pos > 0 AND (loss_mask = 1 OR pos % 4 = 0)")
    ids = F.when(F.col("pos") % 3 == 0, F.reverse("top_ids")).otherwise(F.col("top_ids"))
    return rows.select("trajectory_id", "pos", F.lit(0.25).alias("lse"), ids.alias("ids"), F.array(F.lit(-0.5), F.lit(-2.0)).alias("z"))


def test_evaluation_leaves_the_cache_where_it_lies(spark, store):
    store.append(spark.createDataFrame(rows_of("abc", 2100), SCHEMA))
    version = store.compact(buckets=5)
    chunks = ScoreStore(spark, store.path).chunks()
    student = students(spark, store.positions())
    gathered = divergence.gather_student_chunks(chunks, student.hint("merge"), buckets=version.buckets)
    plan = gathered._jdf.queryExecution().executedPlan().toString()
    cache_side = plan[plan.index("SortMergeJoin") :]
    # One exchange, the student's; the bucketed scan stands under a sort at most.
    assert len(re.findall(r"Exchange hashpartitioning", cache_side)) == 1
    assert "Bucketed: true" in plan
    want = divergence.gather_student(store.positions(), student)
    columns = ["trajectory_id", "pos", "n_missing", "student_logp"]
    assert sorted(map(str, gathered.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assignment = spark.createDataFrame([(t, "train", 0, k) for k, t in enumerate("abc")], "trajectory_id string, split string, batch_id long, slot int")
    (one,) = evaluate_store(store, student, assignment).collect()
    (two,) = evaluate(store.positions(), student, assignment).collect()
    assert one.n_batches == 1 and one.avg_loss == pytest.approx(two.avg_loss)
    with pytest.raises(Exception, match="no batch for trajectory"):
        evaluate_store(store, student, assignment.limit(2)).collect()


def test_a_student_id_listed_twice_is_an_error(spark, store):
    store.append(spark.createDataFrame(rows_of("a", 5), SCHEMA))
    store.compact()
    student = students(spark, store.positions()).withColumn("ids", F.array(F.lit(1), F.lit(1)))
    with pytest.raises(Exception, match="listed twice"):
        divergence.gather_student_chunks(store.chunks(), student).collect()
