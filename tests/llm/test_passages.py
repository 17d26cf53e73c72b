"""Repeated passages against brute force, on awkward rows, small automata and an empty table."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, connect
from tracemill.llm import passages

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def truth(rows, window=35):
    texts = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def found(df, **settings):
    rows = passages.remove_passages(df, **settings).collect()
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r.spans) == r.n_removed
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in rows)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_awkward_rows(awkward, nothing):
    assert found(awkward) == truth(rows_of(awkward))
    assert passages.remove_passages(nothing).count() == 0


def test_random_texts(spark, monkeypatch):
    """Shared passages at all offsets, periodic texts, repeats inside a text, copies."""
    dice = random.Random(7)
    shared = [" ".join(dice.choice("abcdefghij") for _ in range(dice.randint(5, 90))) for _ in range(25)]
    texts = []
    for _ in range(300):
        parts = [dice.choice(shared) if dice.random() < 0.6 else dice.choice("xyz") * dice.randint(1, 4) for _ in range(6)]
        texts.append(" ".join(parts))
    texts += ["a b " * 40, "c " * 200, "c " * 34, "d " * 35, "d " * 35, "d " * 36] + texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = truth(enumerate(texts))
    assert found(df) == want
    # One pattern an automaton, two segments a salt, and phrases dealt over parts and salts.
    monkeypatch.setattr(passages, "LARGE", 1)
    assert found(df, per_automaton=1, per_salt=2) == want
    assert found(df, window=12, phrase=5) == truth(enumerate(texts), 12)


def test_query_equals_sql(spark):
    name = "op11_repeated_passages"
    assert compare(entry_points.queries()[name](spark, SF), connect(SF), entry_points.oracle_sql()[name]) is None


def test_texts_are_shuffled_once(spark):
    """Joins with the stored texts move the other side only."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = passages.distinct_texts(df)
    found = spark.range(5).selectExpr("cast(id as string) as k").selectExpr("cast(k as binary) as key", "k")
    plan = texts.join(found.hint("merge"), "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_runs_do_not_depend_on_the_chunk():
    dice = random.Random(3)
    texts = [" ".join(dice.choice("abc") for _ in range(dice.randint(35, 200))).encode() for _ in range(20)]
    owner, phrases, start, n = passages.runs_of(texts)
    for k, text in enumerate(texts):
        one = passages.runs_of([text])
        assert all(np.array_equal(a[owner == k], b) for a, b in zip((phrases, start, n), one[1:]))
        # Every window is in one run.
        assert one[3].sum() == text.count(b" ") + 1 - 34 and one[3].max() <= 28


def test_wide_windows_are_refused(spark):
    with pytest.raises(ValueError):
        passages.remove_passages(spark.createDataFrame([], "doc_id long, text string"), window=90)
