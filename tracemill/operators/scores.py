"""Top-k extraction and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill import fixed
from tracemill.functions.arrays import fit_length
from tracemill.operators.tokens import valid_mask

# Per sequence: one mapping token id -> score per position (None where there is none), or a dense
# array [positions, vocabulary].
Scorer = Callable[[list[list[int]]], Sequence[Sequence[Mapping[int, float] | None] | np.ndarray]]

SCORED_SCHEMA = (
    "trajectory_id string, seq_len int, prompt_boundary int, pos int, token_id int, loss_mask int, "
    "scores map<int,double>, status string, error string"
)


def top_k_dense(logits: Column, k: int = fixed.TOP_K) -> Column:
    """The k largest entries of a dense score array as structs (val, id), largest first.

    Equal scores are ordered by id.
    """
    ranked = F.sort_array(
        F.transform(logits, lambda z, i: F.struct((-z).alias("neg"), i.alias("id")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda e: F.struct((-e["neg"]).alias("val"), e["id"].alias("id"))
    )


def top_k_rows(scores: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """The same on rows (trajectory_id, pos, token_id, score); adds ``rank`` from 1.

    For large vocabularies: the limit on the rank is applied before the shuffle too.
    """
    best = Window.partitionBy("trajectory_id", "pos").orderBy(F.desc("score"), F.asc("token_id"))
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k_map(scores: Column, k: int = fixed.TOP_K) -> Column:
    """The k best entries of a map token id -> log-probability; NULL for an absent map."""
    ranked = F.sort_array(
        F.transform(
            F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("id"))
        )
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda e: F.struct((-e["neg"]).alias("val"), e["id"].alias("id"))
    )


def with_top_k(df: DataFrame, best: Column) -> DataFrame:
    """Split a top-k column into top_ids (INT) and top_vals (FLOAT)."""
    return (
        df.withColumn("_best", best)
        .withColumn("top_ids", F.col("_best.id").cast("array<int>"))
        .withColumn("top_vals", F.col("_best.val").cast("array<float>"))
        .drop("_best")
    )


def zero_fill(positions: DataFrame, k: int) -> DataFrame:
    """Fill short score arrays up to ``k`` with id 0 and score 0, as fixed-width caches hold them.

    Only to reproduce losses computed on such caches: a log-probability of 0 is probability 1.
    """
    return positions.withColumn("top_ids", fit_length(F.col("top_ids"), k, 0)).withColumn(
        "top_vals", fit_length(F.col("top_vals"), k, F.lit(0.0).cast("float"))
    )


def score_format(tag: Column) -> Column:
    """Format tag of a cache; caches without one hold log-probabilities."""
    return F.coalesce(tag, F.lit(fixed.LOGPROBS))


def score_with(
    samples: DataFrame,
    make_scorer: Callable[[], Scorer],
    batch_size: int = fixed.SCORER_BATCH,
    *,
    top_k: int = fixed.TOP_K,
    partitions: int | None = None,
) -> DataFrame:
    """Score token sequences with a model supplied by the user.

    ``samples`` needs trajectory_id, input_ids, loss_mask and prompt_boundary. ``make_scorer``
    runs once per task; ``partitions`` sets the number of tasks. Each call gets up to
    ``batch_size`` sequences; a sequence without one score for each token is tried once more on
    its own. Dense scores are cut to their ``top_k`` before they leave the task. Result: for every
    sequence one row per position with status ``ok``, or a single row with status ``error`` and
    the message if it cannot be scored in full or is empty.
    """

    chunk_size = fixed.CHUNK_POSITIONS

    def best_of(scores: np.ndarray) -> list[dict[int, float]]:
        k = min(top_k, scores.shape[-1])
        kth = -np.partition(-scores, k - 1, axis=-1)[:, k - 1 : k]
        result = []
        for row, limit in zip(scores, kth):
            ids = np.flatnonzero(row >= limit)
            ids = ids[np.lexsort((ids, -row[ids]))][:k]
            result.append(dict(zip(ids.tolist(), row[ids].astype(float).tolist())))
        return result

    def good(row, maps) -> Iterator[pd.DataFrame]:
        for start in range(0, len(maps), chunk_size):
            chunk = maps[start : start + chunk_size]
            yield pd.DataFrame(
                {
                    "trajectory_id": row.trajectory_id,
                    "seq_len": len(row.input_ids),
                    "prompt_boundary": row.prompt_boundary,
                    "pos": range(start, start + len(chunk)),
                    "token_id": row.input_ids[start : start + len(chunk)],
                    "loss_mask": row.loss_mask[start : start + len(chunk)],
                    "scores": [None if m is None else dict(m) for m in chunk],
                    "status": "ok",
                    "error": None,
                }
            )

    def bad(row, problem) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "trajectory_id": [row.trajectory_id],
                "seq_len": [len(row.input_ids)],
                "prompt_boundary": [row.prompt_boundary],
                "pos": [None],
                "token_id": [None],
                "loss_mask": [None],
                "scores": [None],
                "status": ["error"],
                "error": [f"{type(problem).__name__}: {problem}"],
            }
        )

    def complete(row, maps) -> list:
        """Scores of one sequence, one entry for each token; raises if any is missing."""
        if maps is None:
            raise ValueError("no scores")
        if len(maps) != len(row.input_ids):
            raise ValueError(f"{len(maps)} scores for {len(row.input_ids)} tokens")
        return best_of(maps) if isinstance(maps, np.ndarray) else list(maps)

    def alone(scorer, row) -> list:
        results = scorer([list(row.input_ids)])
        if len(results) != 1:
            raise ValueError(f"{len(results)} answers for one sequence")
        return complete(row, results[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            for first in range(0, len(rows), batch_size):
                group = rows[first : first + batch_size]
                try:
                    results = list(scorer([list(row.input_ids) for row in group]))
                except Exception:
                    results = []
                # Answers cannot be matched to sequences if one is missing: all are asked again.
                matched = results if len(results) == len(group) else [None] * len(group)
                for row, maps in zip(group, matched, strict=True):
                    try:
                        if not len(row.input_ids):
                            raise ValueError("empty sequence")
                        try:
                            found = complete(row, maps)
                        except Exception:
                            found = alone(scorer, row)
                        frames = list(good(row, found))
                    except Exception as problem:
                        frames = [bad(row, problem)]
                    yield from frames

    columns = samples.select("trajectory_id", "input_ids", "loss_mask", "prompt_boundary")
    if partitions:
        columns = columns.repartition(partitions)
    return columns.mapInPandas(run, SCORED_SCHEMA)


def split_by_status(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored positions, and the trajectories set aside with their error."""
    good = scored.filter(F.col("status") == "ok").drop("status", "error")
    failed = scored.filter(F.col("status") != "ok").select("trajectory_id", "status", "error")
    return good, failed


def cache_positions(scored: DataFrame, k: int = fixed.TOP_K, tag: str = fixed.LOGPROBS) -> DataFrame:
    """Scored positions to cache rows: top-k arrays, chunk number, valid positions in the mask."""
    best = with_top_k(scored, top_k_map(F.col("scores"), k)).drop("scores")
    return (
        valid_mask(best)
        .withColumn("chunk", F.floor(F.col("pos") / fixed.CHUNK_POSITIONS).cast("int"))
        .withColumn("format", F.lit(tag))
    )
