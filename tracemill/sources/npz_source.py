"""Score caches as ``.npz`` archives, one for each trajectory, as a data source of Spark's.

Reading: archives are packed into partitions by their sizes, and only the arrays that the requested
columns need are unpacked, 1,024 positions at a time. Writing: each task writes the archives of its
trajectories under a passing name and renames them, so an archive is complete or absent, and a task
that runs twice does no harm. Files are reached through Arrow's file systems, so a folder may be
local or in a store that Arrow knows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tracemill import fixed
from tracemill.sources.npz import IMPORT_SCHEMA

PARTITION_BYTES = 64_000_000
_TYPES = {
    "trajectory_id": pa.string(), "chunk": pa.int32(), "pos": pa.int32(), "token_id": pa.int32(), "loss_mask": pa.int32(),
    "prompt_boundary": pa.int32(), "format": pa.string(), "top_ids": pa.list_(pa.int32()), "top_vals": pa.list_(pa.float32()),
}
COLUMNS = list(_TYPES)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    # Hadoop writes local paths with one slash.
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


@dataclass
class Archives(InputPartition):
    """Paths of the archives that one task reads."""

    paths: tuple[str, ...]


def pack(files: list[tuple[str, int]], most: int) -> list[tuple[str, ...]]:
    """Consecutive files in groups of at most ``most`` bytes; a larger file is alone."""
    groups: list[list[str]] = []
    size = 0
    for path, n_bytes in files:
        if not groups or size + n_bytes > most:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += n_bytes
    return [tuple(g) for g in groups]


class _Reader(DataSourceReader):
    def __init__(self, names: list[str], options):
        self._names, self._path = names, options["path"]
        self._bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self):
        fs, root = _open(self._path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted(
            (f.path, f.size) for f in found if f.base_name.startswith("trajectory_") and f.base_name.endswith(".npz")
        )
        if not files:
            raise ValueError(f"no cached trajectories in {self._path}")
        return [Archives(paths) for paths in pack(files, self._bytes)]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self._path)
        for path in partition.paths:
            with fs.open_input_file(path) as file, np.load(file) as data:
                yield from self._positions(path.rsplit("/", 1)[-1].removesuffix(".npz"), data)

    def _positions(self, name: str, data) -> Iterator[pa.RecordBatch]:
        wanted = set(self._names)
        # An array is unpacked when it is asked for.
        ids = data["input_ids"].reshape(-1)
        mask = data["loss_mask"] if "loss_mask" in wanted and "loss_mask" in data else None
        tag = str(data["format"][0]) if "format" in wanted and "format" in data else None
        boundary = int(data["prompt_boundary"][0]) if "prompt_boundary" in wanted and "prompt_boundary" in data else None
        top_ids = data["indices"].astype(np.int32) if "top_ids" in wanted else None
        top_vals = data["values"].astype(np.float32) if "top_vals" in wanted else None

        def lists(array: np.ndarray, start: int, stop: int, kind: pa.DataType) -> pa.Array:
            scored = array[start:stop]
            offsets = np.minimum(np.arange(stop - start + 1), len(scored)) * array.shape[1]
            empty = pa.array(np.arange(stop - start) >= len(scored))
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(scored.ravel(), kind), mask=empty)

        for start in range(0, len(ids), fixed.CHUNK_POSITIONS):
            stop = min(start + fixed.CHUNK_POSITIONS, len(ids))
            n = stop - start
            made = {
                "trajectory_id": lambda: pa.array([name] * n),
                "chunk": lambda: pa.array(np.full(n, start // fixed.CHUNK_POSITIONS, np.int32)),
                "pos": lambda: pa.array(np.arange(start, stop, dtype=np.int32)),
                "token_id": lambda: pa.array(ids[start:stop].astype(np.int32)),
                "loss_mask": lambda: pa.nulls(n, pa.int32())
                if mask is None
                # A mask that is too short ends in zeros.
                else pa.array(np.pad(mask[start:stop], (0, n - len(mask[start:stop]))).astype(np.int32)),
                "prompt_boundary": lambda: pa.array([boundary] * n, pa.int32()),
                "format": lambda: pa.array([tag] * n, pa.string()),
                "top_ids": lambda: lists(top_ids, start, stop, pa.int32()),
                "top_vals": lambda: lists(top_vals, start, stop, pa.float32()),
            }
            yield pa.RecordBatch.from_arrays([made[c]() for c in self._names], names=self._names)


class _Writer(DataSourceArrowWriter):
    def __init__(self, names: list[str], options):
        self._names, self._path = names, options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _open(self._path)
        fs.create_dir(root, recursive=True)
        held: list[pa.Table] = []
        name = None
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            ids = table["trajectory_id"].to_pylist()
            edges = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                if ids[first] != name and held:
                    self._archive(fs, root, name, pa.concat_tables(held))
                    held = []
                name = ids[first]
                held.append(table.slice(first, last - first))
        if held:
            self._archive(fs, root, name, pa.concat_tables(held))
        return WriterCommitMessage()

    def _archive(self, fs: pafs.FileSystem, root: str, name: str, rows: pa.Table) -> None:
        rows = rows.combine_chunks()
        width = max([len(x) for x in rows["top_ids"].to_pylist() if x is not None], default=0)

        def matrix(column: str, kind) -> np.ndarray:
            out = np.zeros((len(rows), width), kind)
            for k, row in enumerate(rows[column].to_pylist()):
                if row is not None:
                    out[k, : len(row)] = row
            return out

        arrays = {
            "input_ids": rows["token_id"].to_numpy().astype(np.int32),
            "indices": matrix("top_ids", np.int32),
            "values": matrix("top_vals", np.float16),
        }
        for key, column, kind in (("loss_mask", "loss_mask", np.int32), ("prompt_boundary", "prompt_boundary", np.int32)):
            if rows[column].null_count == 0:
                values = rows[column].to_numpy().astype(kind)
                arrays[key] = values[:1] if key == "prompt_boundary" else values
        if rows["format"].null_count == 0:
            arrays["format"] = np.array([rows["format"][0].as_py()])
        buffer = io.BytesIO()
        np.savez_compressed(buffer, **arrays)
        passing, final = f"{root}/.{uuid.uuid4().hex}", f"{root}/trajectory_{quote(name, safe='')}.npz"
        with fs.open_output_stream(passing) as stream:
            stream.write(buffer.getbuffer())
        fs.move(passing, final)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return IMPORT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([f.name for f in schema.fields], self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer([f.name for f in schema.fields], self.options)


def read_npz(spark: SparkSession, folder: str, columns: list[str] | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Positions of all ``trajectory_*.npz`` archives of a folder, in the order of their names.

    The file stem is the trajectory id. Only the arrays behind ``columns`` (all by default) are
    unpacked. Keys that an archive lacks become NULL.
    """
    spark.dataSource.register(NpzSource)
    columns = columns or COLUMNS
    kinds = dict(field.split(" ", 1) for field in IMPORT_SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return spark.read.format("npz").schema(schema).option("partitionBytes", partition_bytes).load(folder)


def write_npz(positions: DataFrame, folder: str) -> None:
    """One archive ``trajectory_<id>.npz`` for each trajectory, in half precision.

    Rows of scores that are NULL or short are filled with zeros, as such archives hold them. A column
    with NULLs (loss_mask, prompt_boundary, format) is left out. A task holds one trajectory at a time.
    """
    positions.sparkSession.dataSource.register(NpzSource)
    kinds = dict(field.split(" ", 1) for field in IMPORT_SCHEMA.split(", "))
    rows = positions.select(*(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))
    ordered = rows.repartition("trajectory_id").sortWithinPartitions("trajectory_id", "pos")
    ordered.write.format("npz").mode("append").save(folder)
