"""Token counts through a cache keyed by digests of content and tokenizer.

The cache is a Parquet table (content digest, tokenizer digest, n_tokens) in shared storage. Texts
are reduced to one for each distinct digest before they are shuffled, those in the cache are
dropped, the rest is encoded and appended; every document then takes its count from the new ones
and from the stored ones with its digest. A run that dies before the append leaves the cache as it was; two runs that append the same digest
do no harm, as counts are read once for each digest.

Content is normalised only in ways that cannot change a count: NULL counts as empty. The tokenizer
digest covers the whole vocabulary file and the pattern, so a new version never meets old counts.

Defined results: NULL and empty texts have no tokens. Repeated rows have the same result each. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.encode import encoder
from tracemill.session import materialise, path_exists

LIMIT = 1024
SCHEMA = "content binary, tokenizer string, n_tokens long"


def tokenizer_digest(path: str, pattern: str) -> str:
    """Digest of a vocabulary file and its pattern, the version of a tokenizer."""
    digest = hashlib.sha256(pattern.encode())
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def _counts(path: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, pattern).encode
        for batch in batches:
            yield pd.DataFrame(
                {"content": batch["content"], "n_tokens": [len(encode(t)) for t in batch["text"]]}
            )

    return run


def _cached(spark, cache: str, version: str) -> DataFrame:
    if not path_exists(spark, cache):
        return spark.createDataFrame([], SCHEMA).select("content", "n_tokens")
    rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.select("content", "n_tokens")


def count_tokens(docs: DataFrame, cache: str, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document; ``cache`` is read, and what it lacks is appended."""
    spark = docs.sparkSession
    version = tokenizer_digest(path, pattern)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    # The first text of a digest is picked by the reading task already, so copies do not travel.
    distinct = rows.groupBy("content").agg(F.first("text").alias("text"))
    stored = _cached(spark, cache, version)
    missing = distinct.join(stored, "content", "left_anti")
    found = materialise(missing.mapInPandas(_counts(path, pattern), "content binary, n_tokens long"), "counts")
    # Of the cache only what this call asks for is taken on.
    known = stored.join(rows.select("content").distinct(), "content", "left_semi")
    counts = known.unionByName(found).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join has two plain exchanges and hot digests can be split.
    counts = materialise(counts, "counts")
    found.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return (
        rows.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "content")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
