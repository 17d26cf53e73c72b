"""Import of score caches kept as one ``.npz`` archive per trajectory."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import fixed

IMPORT_SCHEMA = (
    "trajectory_id string, chunk int, pos int, token_id int, loss_mask int, prompt_boundary int, "
    "format string, top_ids array<int>, top_vals array<float>"
)


def read_npz_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Positions of all ``trajectory_*.npz`` archives; the file stem is the trajectory id."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "trajectory_*.npz")
        .load(folder)
        .select(F.regexp_extract("path", r"([^/]+)\.npz$", 1).alias("trajectory_id"), "content")
    )
    if files.select("trajectory_id").isEmpty():
        raise ValueError(f"no cached trajectories in {folder}")
    return decode_npz(files)


def decode_npz(files: DataFrame) -> DataFrame:
    """Archives (trajectory_id, content) to one row per position, 1,024 positions at a time.

    Keys an archive lacks (format, loss_mask, prompt_boundary) become NULL, a mask that is too
    short ends in zeros. Scores are widened to FLOAT, ids to INT.
    """

    chunk_size = fixed.CHUNK_POSITIONS

    def positions(trajectory_id: str, content: bytes) -> Iterator[pd.DataFrame]:
        with np.load(io.BytesIO(content)) as data:
            ids = data["input_ids"].reshape(-1)
            values, indices = data["values"].astype(np.float32), data["indices"].astype(np.int32)
            mask = data["loss_mask"] if "loss_mask" in data else None
            tag = str(data["format"][0]) if "format" in data else None
            boundary = int(data["prompt_boundary"][0]) if "prompt_boundary" in data else None
        scored = len(values)
        for start in range(0, len(ids), chunk_size):
            here = range(start, min(start + chunk_size, len(ids)))
            yield pd.DataFrame(
                {
                    "trajectory_id": trajectory_id,
                    "chunk": start // chunk_size,
                    "pos": here,
                    "token_id": ids[here.start : here.stop].astype(np.int32),
                    "loss_mask": None if mask is None else [int(mask[p]) if p < len(mask) else 0 for p in here],
                    "prompt_boundary": boundary,
                    "format": tag,
                    "top_ids": [indices[p] if p < scored else None for p in here],
                    "top_vals": [values[p] if p < scored else None for p in here],
                }
            )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for trajectory_id, content in zip(batch["trajectory_id"], batch["content"]):
                yield from positions(trajectory_id, content)

    return files.select("trajectory_id", "content").mapInPandas(run, IMPORT_SCHEMA)
