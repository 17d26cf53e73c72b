"""The score cache: one table of positions, one of headers.

Positions are written first, below ``run_id=.../format=...``; the headers of the run follow. A
run without headers died half-way and is ignored by readers, so running again after a failure
neither loses nor doubles anything.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from tracemill.operators.scores import score_format as tag_or_default
from tracemill.schemas import CACHE_HEADERS, CACHE_POSITIONS
from tracemill.session import join_files, open_files, path_exists

#: Formats of one task that are written without sorting its rows.
FORMATS = 8


def _headers_path(path: str) -> str:
    return f"{path}/headers"


def _positions_path(path: str) -> str:
    return f"{path}/positions"


def cache_exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, _headers_path(path))


def write_cache(positions: DataFrame, path: str, run_id: str | None = None, one_file: bool = False) -> str:
    """Append one run. ``positions`` are cache rows plus ``prompt_boundary``, without ``run_id``.

    A NULL format becomes ``logprobs``; a NULL loss mask stays, and means that none was stored.
    Returns the run id. With ``one_file`` each format ends up in one file, whose row groups are those of the
    files that the tasks have written. The headers are computed from the files just written, not by scoring
    again.
    """
    spark = positions.sparkSession
    run_id = run_id or uuid.uuid4().hex
    target = f"{_positions_path(path)}/run_id={run_id}"
    stored = [f for f in CACHE_POSITIONS if f.name != "run_id"]
    boundary = (
        F.col("prompt_boundary") if "prompt_boundary" in positions.columns else F.lit(None)
    ).cast("int").alias("prompt_boundary")
    positions = positions.withColumn("format", tag_or_default(F.col("format")))
    rows = positions.select(*(F.col(f.name).cast(f.dataType) for f in stored), boundary)
    with open_files(spark, FORMATS):
        rows.write.partitionBy("format").parquet(f"{path}/parts/{run_id}" if one_file else target)
    if one_file:
        join_files(spark, f"{path}/parts/{run_id}", target)
    on_disk = StructType([*stored, StructField("prompt_boundary", IntegerType())])
    written = spark.read.schema(on_disk).parquet(target)
    headers = written.groupBy("trajectory_id").agg(
        (F.max("pos") + 1).alias("seq_len"),
        F.max("format").alias("format"),
        F.max("prompt_boundary").alias("prompt_boundary"),
        (F.count("loss_mask") > 0).alias("has_loss_mask"),
    )
    (
        headers.withColumn("run_id", F.lit(run_id))
        .select(*(F.col(f.name).cast(f.dataType) for f in CACHE_HEADERS))
        .write.mode("append")
        .parquet(_headers_path(path))
    )
    return run_id


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    if not cache_exists(spark, path):
        raise FileNotFoundError(f"no cached trajectories in {path}; write the score cache first")
    return _one_run_each(spark.read.schema(CACHE_HEADERS).parquet(_headers_path(path)))


def _numbered(headers: DataFrame) -> DataFrame:
    # A window holds the runs that cached one trajectory.
    return headers.withColumn("_n", F.row_number().over(Window.partitionBy("trajectory_id").orderBy("run_id")))


def _one_run_each(headers: DataFrame) -> DataFrame:
    """One header for each trajectory: of several runs the one with the smallest id counts."""
    return _numbered(headers).where("_n = 1").drop("_n")


def read_cache(spark: SparkSession, path: str, score_format: str | None = None) -> DataFrame:
    """Positions of all finished runs; scores stay FLOAT, ids INT (pruned by run and format)."""
    headers = read_headers(spark, path)
    # One value per run, not per trajectory.
    runs = [row.run_id for row in headers.select("run_id").distinct().collect()]
    if not runs:
        raise ValueError(f"no cached trajectories in {path}")
    positions = spark.read.schema(CACHE_POSITIONS).parquet(_positions_path(path))
    positions = positions.filter(F.col("run_id").isin(runs))
    # Positions of a trajectory that another run holds too; hardly ever any, so few to send.
    stored = spark.read.schema(CACHE_HEADERS).parquet(_headers_path(path))
    double = _numbered(stored).where("_n > 1").select("trajectory_id", "run_id")
    positions = positions.join(double, ["trajectory_id", "run_id"], "left_anti")
    return positions if score_format is None else positions.filter(F.col("format") == score_format)


def not_cached(trajectories: DataFrame, path: str) -> DataFrame:
    """Rows whose trajectory is not in the cache yet."""
    spark = trajectories.sparkSession
    if not cache_exists(spark, path):
        return trajectories
    return trajectories.join(read_headers(spark, path).select("trajectory_id"), "trajectory_id", "left_anti")


def cache_summary(spark: SparkSession, path: str) -> DataFrame:
    """Cached trajectories, those without a stored loss mask (all their tokens count in the loss),
    files, and their size in GB (1e9 bytes).
    """
    # Runs without headers died half-way; their files do not count.
    finished = [row.run_id for row in read_headers(spark, path).select("run_id").distinct().collect()]
    # Path and length come from the file listing; no file is opened. One row.
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(_positions_path(path))
        .where(F.regexp_extract("path", "/run_id=([^/]+)/", 1).isin(finished))
        .agg(F.count("path").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))
        .first()
    )
    return read_headers(spark, path).agg(
        F.count_distinct("trajectory_id").alias("n_trajectories"),
        F.count_if(~F.col("has_loss_mask")).alias("n_without_mask"),
        F.lit(files.n_files).cast("bigint").alias("n_files"),
        F.lit(files.n_bytes / 1e9).alias("total_gb"),
    )
