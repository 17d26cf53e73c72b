"""Shards by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group. Groups are dealt by hash to cells; in each cell they are placed, largest
first, into the bin where the dot product of the group's size vector with the bin's residual
capacity is highest. The bins of all cells, a number that does not grow with the input, are then
placed into the shards by the same rule. A group that alone exceeds a shard's fair share in any
of the three sizes is split by row first; there are at most three times as many of these as there
are shards, which bounds what is broadcast.

The law is ``bytes``: sizes are near equal. Tokens are words between white space.

Defined results: NULL counts as empty, so it has size 1 and is equal to the empty text. Every row is
placed, repeated rows and rows without doc_id too: groups are split by row, whatever its id. An empty table gives an empty result. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracemill.session import materialise

SHARDS = 16
#: Cells, bins of a cell for each shard, and parts of a shard for numbering its rows.
CELLS, BINS, PARTS = 256, 4, 1024

SIZES = ["bytes", "tokens", "rows"]
#: The law is on bytes, so they weigh most in the dot product.
WEIGHTS = [64.0, 1.0, 1.0]


def _placer(bins: int, share: float, unit: list[str], out: str):
    """Place sorted rows of shares: the bin with the highest dot product takes each row.

    ``share`` is a bin's capacity as a share of everything. State: one vector for each bin.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, room, weights = None, np.full((bins, 3), share), np.array(WEIGHTS)
        for batch in batches:
            cells = batch["cell"].to_numpy()
            vectors = batch[[f"{s}_share" for s in SIZES]].to_numpy(np.float64)
            places = np.empty(len(batch), np.int32)
            for k in range(len(batch)):
                if cells[k] != cell:
                    cell, room = cells[k], np.full((bins, 3), share)
                best = int(np.argmax(room @ (weights * vectors[k])))
                room[best] -= vectors[k]
                places[k] = best
            result = batch[unit].copy()
            result[out] = places
            yield result

    return run


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot and sizes of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"),
        # Fixed by the write: rows that share a doc_id, or have none, are told apart by it.
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    totals = {s: max(1, total[s] or 0) for s in SIZES}

    largest = F.greatest(*[F.col(s) / totals[s] for s in SIZES])
    heavy = rows.groupBy("digest").agg(*sums).where(largest > 1.0 / shards)
    heavy = heavy.select("digest", F.ceil(largest * (2 * shards)).cast("int").alias("parts"))
    heavy = materialise(heavy, "heavy")
    part = F.coalesce(F.pmod(F.xxhash64("row", F.lit(3)), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(heavy), "digest", "left").withColumn("part", part).drop("parts")

    shares = [(F.col(s) / totals[s]).alias(f"{s}_share") for s in SIZES]
    order = [F.desc("bytes_share"), F.desc("tokens_share")]
    cell = F.pmod(F.xxhash64("digest", "part"), F.lit(CELLS)).cast("int")
    units = rows.groupBy("digest", "part").agg(*sums).select("digest", "part", cell.alias("cell"), *shares)
    share_schema = ", ".join(f"{s}_share double" for s in SIZES)
    local = materialise(
        units.repartition("cell")
        .sortWithinPartitions("cell", *order, "digest", "part")
        .mapInPandas(
            _placer(
                BINS * shards,
                1.0 / (CELLS * BINS * shards),
                ["digest", "part", "cell", *[f"{s}_share" for s in SIZES]],
                "bin",
            ),
            f"digest binary, part int, cell int, {share_schema}, bin int",
        ),
        "local-bins",
    )
    # CELLS * BINS * shards rows at most, whatever the input.
    bins = local.groupBy("cell", "bin").agg(*[F.sum(f"{s}_share").alias(f"{s}_share") for s in SIZES])
    bins = bins.select("bin", F.col("cell").alias("home"), F.lit(0).alias("cell"), *[f"{s}_share" for s in SIZES])
    placed = materialise(
        bins.repartition(1)
        .sortWithinPartitions(*order, "home", "bin")
        .mapInPandas(_placer(shards, 1.0 / shards, ["home", "bin"], "shard"), "home int, bin int, shard int"),
        "bins",
    )
    where = local.select("digest", "part", F.col("cell").alias("home"), "bin").join(F.broadcast(placed), ["home", "bin"])
    # Written, so that the join has two plain exchanges and hot digests can be split.
    where = materialise(where.select("digest", "part", "shard"), "places")
    numbered = rows.join(where, ["digest", "part"]).withColumn(
        "_part", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(PARTS)).cast("int")
    )
    numbered = materialise(numbered.select("doc_id", "size", "text_crc32", "shard", "row", "_part"), "placed")
    counts = numbered.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "row")
    return (
        numbered.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("_row")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
