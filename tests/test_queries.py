"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from oracle_check import compare, connect
from tracemill.catalog.oracles import all_oracles
from tracemill.catalog.queries import all_queries
from tracemill.sources import score_cache

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, db, name):
    result = entry_points.queries()[name](spark, SF_DIR)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(result, db, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["trajectory_id", "n_chars", "n_parts", "assistant_share", "prompt_boundary_char"]
    assert result.count() == 9


def test_cache_summary_only_copies_in_one_task(spark, monkeypatch):
    """The two files are written by one task, which must not work out the scores as well."""
    plans, write = [], score_cache.write_cache

    def seen(positions, *args):
        plans.append(positions._jdf.queryExecution().executedPlan().toString())
        return write(positions, *args)

    monkeypatch.setattr(score_cache, "write_cache", seen)
    result = entry_points.queries()["s11_cache_summary"](spark, SF_DIR).first()
    assert result.n_files == 2
    assert not any(step in plan for plan in plans for step in ("Join", "Generate", "Aggregate", "Exchange"))


def test_two_runs_look_scores_up_once(spark, monkeypatch):
    plans, write = [], score_cache.write_cache

    def seen(positions, *args):
        plans.append(positions._jdf.queryExecution().executedPlan().toString())
        return write(positions, *args)

    monkeypatch.setattr(score_cache, "write_cache", seen)
    assert entry_points.queries()["s7_two_runs"](spark, SF_DIR).count() > 0
    assert len(plans) == 2
    assert not any(step in plan for plan in plans for step in ("Join", "Generate", "Aggregate", "Exchange"))
