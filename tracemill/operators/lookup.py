"""Look up one attribute row per key where a few keys make up most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEAD_ROWS = 200_000
_HEAD_KEY_BYTES = 512
_HEAD_BYTES = 64 << 20


def frequent_head(
    table: DataFrame, key: str, rank: str, *, head_rows: int = _HEAD_ROWS, head_bytes: int = _HEAD_BYTES
) -> DataFrame:
    """The first keys of ``table`` by ``rank``, as many as fit ``head_bytes`` of key text.

    A key of more than 512 bytes is not in it, whatever its rank, and neither is one whose rank is
    NULL or ``head_rows`` or more. The window runs over at most ``head_rows`` keys.
    """
    size = F.octet_length(key)
    first = table.where((F.col(rank) < head_rows) & (size <= _HEAD_KEY_BYTES))
    so_far = Window.orderBy(rank, key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("_bytes", F.sum(size).over(so_far)).where(F.col("_bytes") <= head_bytes).drop("_bytes")


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    rank: str,
    *,
    head_rows: int = _HEAD_ROWS,
    head_bytes: int = _HEAD_BYTES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Left join ``rows`` to ``table`` on ``key``, without shuffling the frequent keys.

    ``table`` has one row per key, and ``rank`` orders its keys by how often they occur (0 =
    most often). Its ``frequent_head``, bounded in rows and bytes, is broadcast. Rows that it does
    not cover are joined to the rest by a shuffle, where no key is frequent any more. Whether the
    table has a rest is asked when the query runs: if it has none, the second branch stops at its
    source. No job runs while planning. NULL keys match nothing.

    ``by`` names columns of ``rows`` by which the result will be joined: rows are shuffled by them before
    the frequent entries are added, so that a join by them moves no wide entries.
    """
    added = [c for c in table.columns if c != key]
    head = frequent_head(table, key, rank, head_rows=head_rows, head_bytes=head_bytes).withColumn("_hit", F.lit(True))
    rest = table.join(F.broadcast(head.select(key)), key, "left_anti")
    has_rest = rest.exists()
    covered = rows.join(F.broadcast(head), key, "left")
    placed = rows.repartition(*by).join(F.broadcast(head), key, "left") if by else covered
    missed = covered.where(F.col("_hit").isNull() & F.col(key).isNotNull() & has_rest).select(*rows.columns)
    found = placed.where(F.col("_hit") | F.col(key).isNull() | ~has_rest).select(*rows.columns, *added)
    late = missed.join(rest, key, "left").select(*rows.columns, *added)
    return found.unionByName(late.repartition(*by) if by else late)
