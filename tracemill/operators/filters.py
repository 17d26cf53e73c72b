"""Row filters and the first-N limit."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.session import materialise

#: Groups of so few keys are sorted at the driver; larger ones are told apart by the next bytes.
_LAST_KEYS = 4096
_STEP_BYTES = 2


def is_gold() -> Column:
    return (F.col("resolved") == fixed.GOLD_RESOLVED) & (F.col("exit_status") == fixed.GOLD_EXIT_STATUS)


def gold(df: DataFrame) -> DataFrame:
    """Solved and submitted trajectories; NULL in either flag drops the row."""
    return df.filter(is_gold())


def nth_smallest(keys: DataFrame, n: int, key: str) -> str | None:
    """The ``n``-th smallest text of a column, counting repeats; None if there are fewer. NULLs do not count.

    Nothing is sorted: keys are counted by the two bytes behind their common prefix, and only the
    group that the ``n``-th key falls into is looked at again. The driver sees at most 65,793 counts
    in a round, and at the end at most ``_LAST_KEYS`` keys.
    """
    data = F.col(key).cast("binary")
    inside = keys.select(key).where(F.col(key).isNotNull())
    while True:
        seen = inside.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        if seen.n < n:
            return None
        if seen.low == seen.high:
            return seen.low
        if seen.n <= _LAST_KEYS:
            return inside.orderBy(key).limit(n).collect()[-1][0]
        shared = os.path.commonprefix([seen.low.encode(), seen.high.encode()])
        part = F.substring(data, len(shared) + 1, _STEP_BYTES)
        counts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
        for group in sorted(counts, key=lambda r: bytes(r.part)):
            if n <= group.n:
                break
            n -= group.n
        # Keys that end here have a shorter part, which no longer key shares at this length.
        inside = inside.where(
            F.substring(data, 1, len(shared) + _STEP_BYTES) == F.lit(shared + bytes(group.part))
        )


def first_n(df: DataFrame, n: int | None, key: str = "trajectory_id") -> DataFrame:
    """The first ``n`` rows by ``key``, a text that is unique. ``None`` and 0 mean no limit.

    A limit drops rows without a key. What is returned is a comparison with the last wanted key, so
    it needs no join and reaches the scan.
    """
    if not n:
        return df
    # Written, as every round reads the keys again; trajectories themselves are not.
    last = nth_smallest(materialise(df.select(key), "keys"), n, key)
    return df.where(F.col(key).isNotNull() if last is None else F.col(key) <= last)


def with_messages(df: DataFrame) -> DataFrame:
    """Drop trajectories that are NULL or empty."""
    return df.filter(F.coalesce(F.size("trajectory"), F.lit(0)) > 0)


def has_content(content: Column) -> Column:
    """Neither NULL nor empty; white space counts as content."""
    return F.coalesce(content, F.lit("")) != ""


def drop_empty_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(has_content(F.col("content")))


def min_chars(df: DataFrame, n_chars: str = "n_chars", minimum: int = fixed.MIN_CHARS) -> DataFrame:
    """Keep rows whose rendered trajectory has at least ``minimum`` characters."""
    return df.filter(F.col(n_chars) >= minimum)


def min_tokens(
    df: DataFrame, n_tokens: str = "n_tokens", minimum: int = fixed.MIN_TOKENS, max_tokens: int | None = None
) -> DataFrame:
    """Keep rows with at least ``minimum`` tokens, counted after truncation."""
    counted = F.col(n_tokens)
    if max_tokens is not None:
        counted = F.least(counted, F.lit(max_tokens))
    return df.filter(counted >= minimum)
