"""Batch scoring with balanced cost: tasks of about equal tokens, micro-batches within a token bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill import fixed
from tracemill.operators.scores import Scorer
from tracemill.operators.selection import select_rows
from tracemill.operators.tokens import valid_mask

SCORED = (
    "trajectory_id string, seq_len int, prompt_boundary int, pos int, token_id int, loss_mask int, "
    "top_ids array<int>, top_vals array<float>, status string, error string"
)
#: Padded tokens of one call of the scorer.
BATCH_TOKENS = 65_536
_BUCKETS = 65_536


def balanced(samples: DataFrame, partitions: int) -> DataFrame:
    """Samples dealt over ``partitions`` tasks with about equal numbers of tokens.

    Ids are hashed into 65,536 buckets; the buckets, in order, are cut where the running sum of
    their tokens passes a multiple of the task's share.
    """
    placed = samples.withColumn("_bucket", F.pmod(F.xxhash64("trajectory_id"), F.lit(_BUCKETS)).cast("int"))
    # At most 65,536 rows: the window over all of them and the broadcast are safe.
    sizes = placed.groupBy("_bucket").agg(F.sum(F.size("input_ids")).alias("_tokens"))
    everything = Window.partitionBy()
    before = F.coalesce(
        F.sum("_tokens").over(everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    share = F.greatest(F.sum("_tokens").over(everything) / F.lit(partitions), F.lit(1.0))
    tasks = sizes.select("_bucket", F.least(F.floor(before / share), F.lit(partitions - 1)).cast("int").alias("_task"))
    dealt = placed.join(F.broadcast(tasks), "_bucket")
    return dealt.repartitionById(partitions, F.col("_task")).select(*samples.columns)


def micro_batches(lengths: list[int], max_tokens: int, max_sequences: int) -> Iterator[list[int]]:
    """Numbers of the sequences that are scored together, longest first.

    Padded to its longest, no batch has more than ``max_tokens`` tokens, but for a sequence that is
    longer by itself.
    """
    batch: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        longest = lengths[batch[0]] if batch else lengths[k]
        if batch and (len(batch) == max_sequences or (len(batch) + 1) * longest > max_tokens):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def _best(scores, k: int) -> tuple[list, list]:
    """Ids and values per position from a scorer's answer for one sequence."""
    if isinstance(scores, np.ndarray):
        ids, vals = select_rows(scores.astype(np.float64), k)
        return list(ids.astype(np.int32)), list(vals.astype(np.float32))
    ids, vals = [], []
    for entry in scores:
        ranked = None if entry is None else sorted(entry.items(), key=lambda e: (-e[1], e[0]))[:k]
        ids.append(None if ranked is None else [int(i) for i, _ in ranked])
        vals.append(None if ranked is None else [float(v) for _, v in ranked])
    return ids, vals


def score_arrays(
    samples: DataFrame,
    make_scorer: Callable[[], Scorer],
    *,
    max_tokens: int = BATCH_TOKENS,
    max_sequences: int = fixed.SCORER_BATCH,
    top_k: int = fixed.TOP_K,
    partitions: int | None = None,
) -> DataFrame:
    """Score sequences with the user's model; the best ``top_k`` leave the task as arrays.

    ``samples`` needs trajectory_id, input_ids, loss_mask and prompt_boundary. The scorer gets
    sequences of similar length, see ``micro_batches``. A sequence that it does not answer with one
    entry for each token is asked for once more on its own, and then becomes one row with status
    ``error``; the others have one row per position with status ``ok``.
    """

    def ask(scorer, batch: list) -> list:
        try:
            results = list(scorer([list(row.input_ids) for row in batch]))
        except Exception:
            results = []
        return results if len(results) == len(batch) else [None] * len(batch)

    def answered(scorer, row, scores) -> tuple[list, list]:
        if not len(row.input_ids):
            raise ValueError("empty sequence")
        if scores is None or len(scores) != len(row.input_ids):
            (scores,) = scorer([list(row.input_ids)])
        if scores is None:
            raise ValueError("no scores")
        if len(scores) != len(row.input_ids):
            raise ValueError(f"{len(scores)} scores for {len(row.input_ids)} tokens")
        return _best(scores, top_k)

    def frames(row, ids: list, vals: list) -> Iterator[pd.DataFrame]:
        for start in range(0, len(ids), fixed.CHUNK_POSITIONS):
            part = slice(start, start + fixed.CHUNK_POSITIONS)
            yield pd.DataFrame(
                {
                    "trajectory_id": row.trajectory_id,
                    "seq_len": len(ids),
                    "prompt_boundary": row.prompt_boundary,
                    "pos": range(start, start + len(ids[part])),
                    "token_id": row.input_ids[part],
                    "loss_mask": row.loss_mask[part],
                    "top_ids": ids[part],
                    "top_vals": vals[part],
                    "status": "ok",
                    "error": None,
                }
            )

    def failure(row, problem: Exception) -> pd.DataFrame:
        empty = dict.fromkeys(("pos", "token_id", "loss_mask", "top_ids", "top_vals"))
        message = f"{type(problem).__name__}: {problem}"
        fields = {"trajectory_id": row.trajectory_id, "seq_len": len(row.input_ids), "prompt_boundary": row.prompt_boundary}
        return pd.DataFrame([{**fields, **empty, "status": "error", "error": message}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            for together in micro_batches([len(r.input_ids) for r in rows], max_tokens, max_sequences):
                group = [rows[k] for k in together]
                for row, scores in zip(group, ask(scorer, group), strict=True):
                    try:
                        ids, vals = answered(scorer, row, scores)
                    except Exception as problem:
                        yield failure(row, problem)
                        continue
                    yield from frames(row, ids, vals)

    columns = samples.select("trajectory_id", "input_ids", "loss_mask", "prompt_boundary")
    return (balanced(columns, partitions) if partitions else columns).mapInPandas(run, SCORED)


def cache_rows(scored: DataFrame, tag: str = fixed.LOGPROBS) -> DataFrame:
    """Scored rows as rows of the cache: chunk number, format, valid positions in the mask."""
    chunk = F.floor(F.col("pos") / fixed.CHUNK_POSITIONS).cast("int")
    return valid_mask(scored).withColumn("chunk", chunk).withColumn("format", F.lit(tag))
