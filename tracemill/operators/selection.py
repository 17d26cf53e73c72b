"""Top-k of dense scores by partial selection, in Arrow batches (64 MB each, Spark's default)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed

_BLOCK_VALUES = 2_000_000
_TYPE = "struct<ids: array<int>, vals: array<float>>"
_ARROW = pa.struct([("ids", pa.list_(pa.int32())), ("vals", pa.list_(pa.float32()))])


def select_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the k largest of each row, largest first, equal ones by id; NaN comes last.

    The k-th largest value is found by partition; only the k chosen are sorted.
    """
    n, width = scores.shape
    k = min(k, width)
    if not n or not k:
        return np.zeros((n, k), np.int64), np.zeros((n, k), scores.dtype)
    clean = np.where(np.isnan(scores), -np.inf, scores)
    limit = np.partition(clean, width - k, axis=1)[:, width - k, None]
    above = clean > limit
    # Of the entries at the limit those with the smallest ids, and real ones before NaN.
    level = clean == limit
    real = level & ~np.isnan(scores)
    place = np.where(real, np.cumsum(real, axis=1), real.sum(axis=1)[:, None] + np.cumsum(level & ~real, axis=1))
    chosen = above | (level & (place <= k - above.sum(axis=1)[:, None]))
    ids = np.nonzero(chosen)[1].reshape(n, k)
    order = np.lexsort((np.isnan(np.take_along_axis(scores, ids, axis=1)), -np.take_along_axis(clean, ids, axis=1)), axis=1)
    ids = np.take_along_axis(ids, order, axis=1)
    return ids, np.take_along_axis(scores, ids, axis=1)


def _partial(k: int):
    def best(logits: pa.Array) -> pa.Array:
        # Rows of one length are next to each other as a rule, and form one matrix.
        lengths = logits.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        values = logits.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
        ids, vals, counts, row = [], [], np.maximum(np.minimum(lengths, k), 0), 0
        while row < len(lengths):
            width = int(lengths[row])
            end = row + 1
            while end < len(lengths) and lengths[end] == width and (end - row) * max(width, 1) < _BLOCK_VALUES:
                end += 1
            if width > 0:
                block = values[starts[row] : starts[end]].reshape(end - row, width)
                chosen = select_rows(block, k)
                ids.append(chosen[0].ravel())
                vals.append(chosen[1].ravel())
            row = end
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        flat = [np.concatenate(part) if part else np.zeros(0) for part in (ids, vals)]
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(flat[0].astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(flat[1].astype(np.float32))),
        ]
        return pa.StructArray.from_arrays(lists, fields=list(_ARROW), mask=pa.array(lengths < 0))

    return best


def top_k_partial(logits: Column, k: int = fixed.TOP_K) -> Column:
    """The k largest entries of a dense score array as a struct of arrays (ids, vals).

    Largest first, equal scores by id; NaN and NULL entries come last. NULL for a NULL array.
    """
    return F.arrow_udf(_partial(k), _TYPE)(logits)


def with_top_k_partial(df: DataFrame, logits: str = "logits", k: int = fixed.TOP_K) -> DataFrame:
    """Dense scores replaced by top_ids (INT) and top_vals (FLOAT)."""
    chosen = df.withColumn("_best", top_k_partial(F.col(logits), k)).drop(logits)
    return chosen.withColumn("top_ids", F.col("_best.ids")).withColumn("top_vals", F.col("_best.vals")).drop("_best")
