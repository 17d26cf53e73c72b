"""Exact duplicates with a split for heavy hitters.

Texts are equal when their digests, taken without white space, are equal. Misra-Gries summaries
find the digests that may hold more than 1/(k+1) of the rows; an exact pass counts these at most
k digests and picks their winners, which are broadcast, so that rows of hot groups never meet in
one task. All other digests go through an ordinary aggregation and join.

Of equal texts the row with the most code points stays, then the smallest doc_id (NULL last).

Defined results: NULL counts as empty, and all empty texts are equal. Rows that repeat a doc_id
and text share its winner, so both say ``kept``; ``keep_unique`` returns one of them. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import free_name
from tracemill.session import materialise

#: Counters of a Misra-Gries summary; no more winners than this are ever broadcast.
COUNTERS = 4096


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text without white space; NULL counts as empty."""
    plain = F.coalesce(text, F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    return F.unhex(F.sha2(plain, 256))


def _summaries(counters: int):
    def shrink(counts: pd.Series) -> pd.Series:
        if len(counts) <= counters:
            return counts
        cut = counts.nlargest(counters + 1).iloc[-1]
        counts = counts - cut
        return counts[counts > 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = pd.Series(dtype="int64")
        for batch in batches:
            counts = shrink(counts.add(batch["digest"].value_counts(), fill_value=0).astype("int64"))
        yield pd.DataFrame({"digest": counts.index.to_numpy(dtype=object), "n": counts.to_numpy()})

    return run


def frequent_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them all with more than 1/(counters+1) of the rows.

    One summary for each partition; summaries are merged by adding counters and taking the
    (k+1)-th largest off all, which keeps the guarantee.
    """
    found = (
        rows.select("digest")
        .mapInPandas(_summaries(counters), "digest binary, n long")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
    )
    top = found.orderBy(F.desc("n"), "digest").limit(counters + 1)
    beyond = [r.n for r in top.select("n").collect()]
    cut = beyond[counters] if len(beyond) > counters else 0
    return top.where(F.col("n") > cut).select("digest")


def _winner() -> list[Column]:
    """Winner and size of a group: most code points, then smallest doc_id, NULL last."""
    rank = F.struct(
        (-F.col("n_points")).alias("r"), F.col("doc_id").isNull().alias("m"), F.col("doc_id").alias("keep_id")
    )
    return [F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size")]


def exact_groups(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row for each document: its group's winner and size, and whether it stays."""
    rows = materialise(
        docs.select(
            "doc_id",
            digest_of(F.col("text")).alias("digest"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points"),
        ),
        "digests",
    )
    hot = materialise(frequent_digests(rows, counters), "hot-digests")
    # Verified by exact counts: a hot digest's rows are aggregated in the task that reads them.
    winners = materialise(
        rows.join(F.broadcast(hot), "digest").groupBy("digest").agg(*_winner()), "hot-winners"
    )
    split = rows.join(F.broadcast(winners), "digest", "left")
    columns = ["doc_id", "digest", "n_points", "best", "group_size"]
    frequent = split.where(F.col("best").isNotNull()).select(columns)
    rest = split.where(F.col("best").isNull()).select("doc_id", "digest", "n_points")
    groups = rest.groupBy("digest").agg(*_winner())
    ordinary = rest.join(groups, "digest").select(columns)
    both = frequent.unionByName(ordinary)
    return both.select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_unique(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One document of each group of equal texts, with the columns of ``docs``."""
    name = free_name(docs, "_key")

    def key(digest: Column) -> Column:
        return F.concat_ws(" ", digest, F.col("doc_id").cast("string")).alias(name)

    keep = exact_groups(docs, counters).where("kept").select(key(F.col("text_sha256"))).distinct()
    keyed = docs.select("*", key(F.lower(F.hex(digest_of(F.col("text"))))))
    # Both steps need the same partitioning, so repeated rows go without another shuffle.
    return keyed.join(keep, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
