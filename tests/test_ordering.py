"""Running values, row numbers and look-ups, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators.lookup import lookup
from tracemill.operators.ordering import grouped_index, hash_index, ordered_index, running


@pytest.fixture(scope="module")
def skewed():
    """(key, order, value) with gaps in the order; key ``hot`` holds most rows."""
    rng = random.Random(7)
    rows = [("hot", i, rng.randrange(50)) for i in range(3000) if rng.random() < 0.8]
    rows += [(f"k{i % 40}", i, rng.randrange(50)) for i in range(600)]
    rng.shuffle(rows)
    return rows


def test_running(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, o int, v int").repartition(7)
    got = running(
        df,
        ["k"],
        "o",
        before={
            "s": ("sum", F.col("v")),
            "lo": ("min", F.col("v")),
            "hi": ("max", F.col("v")),
            "prev": ("last", F.col("v")),
        },
        totals={"total": "s"},
        chunk_rows=64,
    )
    got = {(r.k, r.o): (r.s, r.lo, r.hi, r.prev, r.total) for r in got.collect()}
    want = {}
    for key in {k for k, _, _ in skewed}:
        seen = []
        rows = sorted((o, v) for k, o, v in skewed if k == key)
        total = sum(v for _, v in rows)
        for o, v in rows:
            want[key, o] = (
                sum(seen),
                min(seen) if seen else None,
                max(seen) if seen else None,
                seen[-1] if seen else None,
                total,
            )
            seen.append(v)
    assert got == want


def test_running_splits_a_key(spark, skewed):
    """After a join on the key, the window still runs on chunks of it."""
    df = spark.createDataFrame(skewed, "k string, o int, v int")
    wanted = df.select("k").distinct().hint("merge")
    joined = df.join(wanted, "k", "left_semi")
    plan = running(joined, ["k"], "o", before={"s": ("sum", F.col("v"))})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2


def test_ordered_index(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, o int, v int").select("k", "o").repartition(5)
    got = ordered_index(df, [F.desc("o"), "k"]).collect()
    want = sorted(((k, o) for k, o, _ in skewed), key=lambda x: (-x[1], x[0]))
    assert [(r.k, r.o) for r in sorted(got, key=lambda r: r.idx)] == want
    assert sorted(r.idx for r in got) == list(range(len(want)))


def test_ordered_index_of_nothing(spark):
    assert ordered_index(spark.createDataFrame([], "k string"), ["k"]).count() == 0


def test_grouped_index(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, o int, v int").select("k", "o")
    got = {(r.k, r.o): r.idx for r in grouped_index(df, "k", ["o"], chunk_rows=100).collect()}
    want = {}
    for key in {k for k, _, _ in skewed}:
        for i, o in enumerate(sorted(o for k, o, _ in skewed if k == key)):
            want[key, o] = i
    assert got == want


def test_hash_index(spark):
    import hashlib

    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = hash_index(df, "k", "42").collect()
    want = sorted(map(str, range(500)), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert [r.k for r in sorted(got, key=lambda r: r.idx)] == want
    assert {r.n_total for r in got} == {500}


@pytest.mark.parametrize("head_rows", [0, 2, 1000])
def test_lookup(spark, head_rows):
    table = spark.createDataFrame(
        [("a", 0, 1.0), ("b", 1, 2.0), ("c", 2, None), ("x" * 200, 3, 4.0)], "key string, rank int, val double"
    )
    keys = ["a"] * 50 + ["b"] * 3 + ["c", "zzz", None, "x" * 200]
    rows = spark.createDataFrame(list(enumerate(keys)), "i int, key string")
    got = {r.i: (r.rank, r.val) for r in lookup(rows, table, "key", "rank", head_rows=head_rows).collect()}
    known = {"a": (0, 1.0), "b": (1, 2.0), "c": (2, None), "x" * 200: (3, 4.0)}
    assert got == {i: known.get(key, (None, None)) for i, key in enumerate(keys)}
