"""Tokenized samples on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.schemas import TOKENIZED


def write_tokenized(samples: DataFrame, path: str) -> None:
    samples.select(*(samples[f.name].cast(f.dataType) for f in TOKENIZED)).write.mode("overwrite").parquet(path)


def read_tokenized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKENIZED).parquet(path)
