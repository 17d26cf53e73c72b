"""Running values and row numbers that never put a whole key, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.session import materialise

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    before: Mapping[str, tuple[str, Column]],
    totals: Mapping[str, str] | None = None,
    chunk_rows: int = 1024,
) -> DataFrame:
    """Add, per key, aggregates over all rows before the current one.

    ``before`` maps a new column to ``(kind, expression)``, kind being sum, min, max or last
    (the value of the row just before). Sums start at 0, the others at NULL. ``totals`` maps a
    new column to the name of a sum in ``before`` whose total over the key it holds.

    ``order`` must be a non-negative integer, unique within the key. Rows are cut into chunks of
    ``chunk_rows`` consecutive order values: windows run inside a chunk, and only one row per
    chunk takes part in the running value over the key. A key with very many rows is therefore
    spread over many tasks.
    """
    group = [*keys, "_chunk"]
    chunked = df.select(
        "*",
        F.floor(F.col(order) / F.lit(chunk_rows)).alias("_chunk"),
        *(expression.alias(f"_in_{name}") for name, (_, expression) in before.items()),
    )

    summaries = []
    for name, (kind, _) in before.items():
        source = F.col(f"_in_{name}")
        merged = F.max_by(source, F.col(order)) if kind == "last" else _MERGE[kind](source)
        summaries.append(merged.alias(f"_sum_{name}"))
    # Spark would accept a partitioning by the key alone here and below, left by a join before;
    # the repartitions make it split the key.
    per_chunk = chunked.repartition(*group).groupBy(*group).agg(*summaries)

    over_key = Window.partitionBy(*keys)
    earlier_chunks = over_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, (kind, _) in before.items():
        summary = F.col(f"_sum_{name}")
        value = (
            F.lag(summary).over(over_key.orderBy("_chunk"))
            if kind == "last"
            else _MERGE[kind](summary).over(earlier_chunks)
        )
        carried.append(value.alias(f"_base_{name}"))
    for name, source in (totals or {}).items():
        carried.append(F.sum(f"_sum_{source}").over(over_key).alias(name))
    offsets = per_chunk.select(*group, *carried)

    in_chunk = Window.partitionBy(*group).orderBy(order)
    earlier_rows = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    inner = [(F.row_number().over(in_chunk) == 1).alias("_first")]
    for name, (kind, _) in before.items():
        source = F.col(f"_in_{name}")
        value = F.lag(source).over(in_chunk) if kind == "last" else _MERGE[kind](source).over(earlier_rows)
        inner.append(value.alias(f"_loc_{name}"))
    local = chunked.repartition(*group).select(*df.columns, "_chunk", *inner)

    # Both sides are partitioned by now and ``local`` is sorted, so a merge costs next to nothing;
    # left alone, AQE may broadcast the wide side while it does not know the other one yet.
    joined = local.join(offsets.hint("merge"), group)
    results = []
    for name, (kind, _) in before.items():
        base, loc = F.col(f"_base_{name}"), F.col(f"_loc_{name}")
        if kind == "sum":
            value = F.coalesce(base, F.lit(0)) + F.coalesce(loc, F.lit(0))
        elif kind == "min":
            value = F.least(base, loc)
        elif kind == "max":
            value = F.greatest(base, loc)
        else:
            value = F.when(F.col("_first"), base).otherwise(loc)
        results.append(value.alias(name))
    return joined.select(*df.columns, *results, *(totals or {}))


def ordered_index(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2 ... in the given order, which must leave no ties.

    Range-partitions and sorts, writes the result to the shared folder (so that partition
    numbers are fixed), then adds each partition's offset. Pass narrow rows: keys, not payload.
    """
    exprs = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = (
        df.repartitionByRange(*exprs)
        .sortWithinPartitions(*exprs)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    # monotonically_increasing_id: partition number above bit 33, row number below.
    placed = (
        materialise(placed, "ordered")
        .withColumn("_part", F.shiftright("_place", 33))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # One row per partition of the write above: small enough for the driver, and counted once.
    sizes = sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = [0, *accumulate(size.n for size in sizes)]
    numbers = [size._part for size in sizes]
    offsets = df.sparkSession.createDataFrame(
        pa.table({"_part": pa.array(numbers, pa.int64()), "_base": pa.array(starts[: len(numbers)], pa.int64())})
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_base") + F.col("_row")).alias(name)
    )


def grouped_index(
    df: DataFrame, group: str, order: Sequence[str], name: str = "idx", chunk_rows: int = 1_000_000
) -> DataFrame:
    """Number the rows of each group 0, 1, 2 ... in the given order, which must leave no ties.

    The rows are numbered over the whole table in (group, order) order and the first number of
    the group is taken off. That number is joined per group and chunk of consecutive numbers, so
    a group with very many rows is spread over many tasks.
    """
    placed = ordered_index(df, [group, *order], "_all").withColumn(
        "_chunk", F.floor(F.col("_all") / chunk_rows)
    )
    spans = placed.groupBy(group).agg(F.min("_all").alias("_start"), F.max("_all").alias("_end"))
    starts = spans.select(
        group,
        "_start",
        F.explode(F.sequence(F.floor(F.col("_start") / chunk_rows), F.floor(F.col("_end") / chunk_rows))).alias("_chunk"),
    )
    return placed.join(starts, [group, "_chunk"]).select(
        *df.columns, (F.col("_all") - F.col("_start")).alias(name)
    )


def hash_index(
    df: DataFrame,
    key: str,
    seed: str,
    *,
    name: str = "idx",
    total: str = "n_total",
    within: Sequence[str] = (),
) -> DataFrame:
    """Number the rows 0, 1, 2 ... in the order of md5(seed:key), and add the row count.

    A repeatable shuffle. Digests of unique keys are uniform, so their first four digits cut the
    rows into 65,536 even buckets without sampling; rows are ranked inside their bucket.
    ``within`` numbers each value of the given columns, which must be few, on its own.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn(
        "_bucket", F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int")
    )
    group = [*within, "_bucket"]
    # At most 65,536 rows (per value of ``within``): the window over all of them and the broadcast
    # are safe.
    sizes = hashed.groupBy(*group).agg(F.count("*").alias("_size"))
    everything = Window.partitionBy(*within)
    earlier = everything.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *group,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_size").over(everything).alias(total),
    )
    in_bucket = Window.partitionBy(*group).orderBy("_digest", key)
    return (
        hashed.withColumn("_rank", F.row_number().over(in_bucket) - 1)
        .join(F.broadcast(offsets), group)
        .select(*df.columns, (F.col("_base") + F.col("_rank")).alias(name), total)
    )
