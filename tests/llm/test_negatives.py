"""Hard negatives against brute force, and the tree against all of its points."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from oracle_check import compare, connect
from tracemill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def truth(rows, every):
    usable = {
        (i, label, tuple(v)) for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    prepared = set()
    for i, label, v in usable:
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        prepared.add((i, label, tuple(max(-(2**24), min(2**24, math.floor(256 * float(x)))) for x in v)))

    def first(scored):
        return sorted(scored, key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))[:5]

    out = Counter()
    for anchor in prepared:
        if anchor[0] is None or anchor[0] % every:
            continue
        scored = [
            (sum(x * y for x, y in zip(anchor[2], r[2])), r) for r in prepared if r is not anchor and len(r[2]) == len(anchor[2])
        ]
        for high, positive in first(s for s in scored if s[1][1] == anchor[1]):
            window = [s for s in scored if s[1][1] != anchor[1] and 80 * high <= 100 * s[0] <= 100 * high]
            for rank, (score, r) in enumerate(first(window), 1):
                out[anchor[0], positive[0], rank, r[0], high, score] += 1
    return out


def found(df, **settings):
    return Counter(tuple(r) for r in negatives.hard_negatives(df, **settings).collect())


@pytest.fixture(scope="module")
def awkward_rows():
    dice = random.Random(5)
    base = [[dice.uniform(-1, 1) for _ in range(4)] for _ in range(30)]
    rows = []
    for i in range(600):
        v = list(dice.choice(base)) if dice.random() < 0.5 else [dice.uniform(-1, 1) * dice.choice([0, 1, 3]) for _ in range(4)]
        if dice.random() < 0.03:
            v[1] = dice.choice([None, float("nan"), float("inf"), 3e38])
        if dice.random() < 0.05:
            v = dice.choice([None, v[:3], []])
        rows.append((dice.choice([i] * 12 + [None]), dice.choice([0, 1, 2, 9, None]), v))
    # Very many copies of one vector, and repeated rows.
    return rows + [(1000 + k, k % 2, base[0]) for k in range(300)] + rows[:40]


def test_awkward_rows(spark, awkward_rows):
    df = spark.createDataFrame(awkward_rows, SCHEMA)
    for name in ("id", "vec", "dims", "cell", "part", "anchor", "rank", "bar"):
        df = df.withColumn(name, F.lit("clash"))
    want = truth(awkward_rows, 5)
    assert want and found(df, every=5) == want
    assert found(df, every=5, part_rows=20, cell_rows=40, block_rows=7) == want
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    name, sf = "op13_hard_negatives", "/root/testdata/sf0.01"
    assert compare(entry_points.queries()[name](spark, sf), connect(sf), entry_points.oracle_sql()[name]) is None


def tree_of(vectors):
    whole = np.floor(256 * vectors)
    top = float(np.sqrt((whole * whole).sum(axis=1)).max()) * (1 + 1e-12) + 1e-9
    return negatives.CoverTree(np.arange(len(whole)), np.zeros(len(whole), dtype=int), whole, top), whole


def test_bounds_hold():
    """Covering radii bound the products of all points below a node, and shrink from level to level."""
    rng = np.random.default_rng(1)
    tree, whole = tree_of(rng.normal(size=(1500, 3)))

    def below(node):
        if tree.members[node] is not None:
            return tree.members[node]
        return np.concatenate([below(k) for k in range(*tree.children[node])])

    q = np.floor(256 * rng.normal(size=(20, 3)))
    exact = q @ whole.T
    for node in range(len(tree.centres)):
        points = below(node)
        low, high = negatives._bounds(q, tree._centres[[node]], tree._radii[[node]], tree.top)
        assert (low[:, 0] <= exact[:, points].min(axis=1)).all() and (exact[:, points].max(axis=1) <= high[:, 0]).all()
    assert sorted(below(0)) == list(range(1500))


def test_nodes_are_skipped():
    """A descent verifies few of the points where vectors lie in clusters."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    tree, whole = tree_of(np.repeat(centres, 100, axis=0) + rng.normal(size=(4000, 16)) * 0.05)
    seen = []
    products = tree.products
    tree.products = lambda q, members: seen.append(len(members)) or products(q, members)
    search = negatives._Search(
        tree, whole[:1], np.array([-1]), np.array([0]), np.array([[negatives._FAR]]), np.array([[1 << 62]]), True, 5
    )
    search.run()
    exact = whole @ whole[0]
    assert list(zip((-search.scores).tolist(), search.found.tolist())) == sorted(zip((-exact).astype(int).tolist(), range(4000)))[:5]
    assert sum(seen) < 800
