"""Choice among the sources a training run can start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.session import path_exists
from tracemill.sources.score_cache import read_cache
from tracemill.sources.tokenized import read_tokenized, write_tokenized


def choose_source(
    spark: SparkSession,
    *,
    cache_path: str | None,
    tokenized_path: str | None,
    tokenize_raw: Callable[[], DataFrame],
) -> tuple[str, DataFrame]:
    """The score cache if its folder exists (an empty one is an error), else the tokenized table, else raw data tokenized now.

    In the last case the result is written to ``tokenized_path``, if given, and read from there.
    Returns the name of the source (cache, tokenized or raw) and its rows.
    """
    if cache_path and path_exists(spark, cache_path):
        return "cache", read_cache(spark, cache_path)
    if tokenized_path and path_exists(spark, tokenized_path):
        return "tokenized", read_tokenized(spark, tokenized_path)
    samples = tokenize_raw()
    if tokenized_path:
        write_tokenized(samples, tokenized_path)
        samples = read_tokenized(spark, tokenized_path)
    return "raw", samples
