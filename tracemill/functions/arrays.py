"""Array columns: running sums, padding, cutting to length.

Catalyst merges neighbouring projections, and an expression merged into a lambda is evaluated
once per element. So lambdas here use only their own arguments; a per-row scalar is passed in
with ``array_repeat`` or as the start value of ``aggregate``. The one exception is marked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

@F.arrow_udf(T.ArrayType(T.LongType()))
def _exclusive_sums(values: pa.Array) -> pa.Array:
    """Per row the sums of the entries before each one; NULL behind a NULL entry."""
    sizes = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = values.flatten()
    ends = np.cumsum(sizes)
    starts = ends - sizes

    def before(numbers: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(numbers, dtype=np.int64)))
        return total[:-1] - np.repeat(total[starts], sizes)

    sums = before(entries.fill_null(0).to_numpy(zero_copy_only=False))
    unknown = before(entries.is_null().to_numpy(zero_copy_only=False)) > 0 if entries.null_count else None
    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
    mask = values.is_null() if values.null_count else None
    return pa.ListArray.from_arrays(offsets, pa.array(sums, pa.int64(), mask=unknown), mask=mask)


def running_sum(values: Column, of: Callable[[Column], Column] | None = None) -> Column:
    """Exclusive running sums of ``of(value)``, as BIGINTs: [3, 1, 2] -> [0, 3, 4].

    The sums of a batch of rows are taken at once: a fold over an array would copy what it has
    so far for every entry. Only numbers travel, 8 bytes an entry.
    """
    numbers = values if of is None else F.transform(values, of)
    return _exclusive_sums(numbers.cast("array<bigint>"))


def fit_length(values: Column, length: Column | int, fill: Column | int) -> Column:
    """Cut ``values`` to ``length`` entries or extend it on the right with ``fill``."""
    length = F.lit(length) if isinstance(length, int) else length
    fill = F.lit(fill) if isinstance(fill, int) else fill
    missing = F.greatest(length - F.size(values), F.lit(0))
    return F.concat(F.slice(values, F.lit(1), length), F.array_repeat(fill, missing))


def as_text(values: Column, digits: int | None = None) -> Column:
    """An array as one comma-separated string, for results that must be scalars."""
    if digits is not None:
        values = F.transform(values, lambda x: F.format_string(f"%.{digits}f", x.cast("double")))
    return F.array_join(values.cast("array<string>"), ",")
