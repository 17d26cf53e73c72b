"""Trajectory tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracemill.operators.lookup import lookup
from tracemill.operators.ordering import ordered_index
from tracemill.schemas import TRAJECTORIES
from tracemill.session import path_exists

_BROKEN = "_broken_line"


def load_trajectories(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Raw trajectories from Parquet or JSON lines, read with the fixed schema."""
    if file_format not in ("parquet", "json"):
        raise ValueError(f"unknown trajectory format {file_format!r}")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no trajectories at {path}")
    if file_format == "json":
        # A broken line would become a row of NULLs; it stops the job instead.
        return spark.read.schema(TRAJECTORIES).option("mode", "FAILFAST").json(path)
    return spark.read.schema(TRAJECTORIES).parquet(path)


def load_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trajectories of JSON lines, and the lines that cannot be read as one (``line``)."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no trajectories at {path}")
    schema = StructType([*TRAJECTORIES, StructField(_BROKEN, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}
    rows = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("value").alias("line"), F.from_json("value", schema, options).alias("row")
    )
    broken = F.col(f"row.{_BROKEN}").isNotNull()
    return rows.where(~broken).select("row.*").drop(_BROKEN), rows.where(broken).select("line")


def flag_ids(trajectories: DataFrame) -> DataFrame:
    """Add ``id_fault``: ``missing`` for a NULL id, ``repeated`` for one of several rows, else NULL.

    Ids are counted first, and the repeated ones written, most frequent first. The frequent ones are
    looked up without a shuffle, rows without an id too, so that no task reads all rows of one id.
    """
    id_ = F.col("trajectory_id")
    ids = trajectories.where(id_.isNotNull()).groupBy("trajectory_id").agg(F.count("*").alias("_rows"))
    repeated = ordered_index(ids.where(F.col("_rows") > 1), [F.desc("_rows"), F.asc("trajectory_id")], "_rank")
    flagged = lookup(trajectories, repeated, "trajectory_id", "_rank")
    fault = F.when(id_.isNull(), "missing").when(F.col("_rows").isNotNull(), "repeated")
    return flagged.select(*trajectories.columns, fault.alias("id_fault"))


def split_by_id(trajectories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trajectories that their id names alone, and the others with ``id_fault``."""
    flagged = flag_ids(trajectories)
    sound = flagged.where(F.col("id_fault").isNull()).drop("id_fault")
    return sound, flagged.where(F.col("id_fault").isNotNull())


def require_ids(trajectories: DataFrame) -> DataFrame:
    """The same rows; the job stops at a NULL or repeated id, which would merge trajectories."""
    flagged = flag_ids(trajectories)
    message = F.concat(F.col("id_fault"), F.lit(" trajectory id: "), F.coalesce("trajectory_id", F.lit("NULL")))
    checked = F.when(F.col("id_fault").isNull(), F.col("trajectory_id")).otherwise(F.raise_error(message).cast("string"))
    return flagged.withColumn("trajectory_id", checked).drop("id_fault")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """The prepared gold set; tells what to run if it is missing."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no gold set at {path}; write it first with write_gold")
    return spark.read.schema(TRAJECTORIES).parquet(path)


def write_gold(trajectories: DataFrame, path: str) -> None:
    trajectories.select(*TRAJECTORIES.fieldNames()).write.mode("overwrite").parquet(path)
