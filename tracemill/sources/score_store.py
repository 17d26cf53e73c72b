"""The score cache as a versioned store: appended runs, compacted into a clustered generation.

``runs/`` holds positions as the scorer wrote them, one folder for each run. ``generations/`` holds
merged runs as chunk rows, bucketed by (trajectory_id, chunk), so that evaluation joins them without
moving them. A chunk is ``CHUNK_POSITIONS`` positions, so no row grows with its trajectory. What
counts is named by the newest manifest; folders that none names are left by runs that died.

Where several runs hold a trajectory, the one that was committed first counts. Trajectories that
could not be scored go to ``quarantine/``, partitioned by run, with the number of the attempt.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed
from tracemill.operators.scores import score_format as tag_or_default
from tracemill.schemas import CACHE_HEADERS, CACHE_POSITIONS
from tracemill.session import path_exists
from tracemill.sources import manifest
from tracemill.sources.clustered import write_clustered

KEYS = ["trajectory_id", "chunk"]
#: Positions and scores of a bucket. A columnar reader decodes 4,096 chunk rows at once, that is a whole bucket.
BUCKET_ENTRIES = 1 << 20
_IN_CHUNK = ("pos", "token_id", "loss_mask", "is_valid", "top_ids", "top_vals")
_STORED = T.StructType(
    [*(f for f in CACHE_POSITIONS if f.name != "run_id"), T.StructField("prompt_boundary", T.IntegerType())]
)
_ROWS = T.ArrayType(T.StructType([CACHE_POSITIONS[name] for name in _IN_CHUNK]), False)
CHUNKS = T.StructType(
    [CACHE_POSITIONS["trajectory_id"], CACHE_POSITIONS["chunk"], CACHE_POSITIONS["format"], T.StructField("rows", _ROWS)]
)
_QUARANTINE = "trajectory_id string, error string, attempt int, run_id string"


@dataclass(frozen=True)
class Snapshot:
    """One version: the runs not merged yet, in the order of their commits, and the generation."""

    version: int
    runs: tuple[str, ...] = ()
    generation: str | None = None
    buckets: int = 0


class RepeatedTrajectory(ValueError):
    pass


def chunk_of(pos: Column) -> Column:
    return F.floor(pos / fixed.CHUNK_POSITIONS).cast("int")


def to_chunks(positions: DataFrame) -> DataFrame:
    """Positions to chunk rows, each ordered by position."""
    rows = F.sort_array(F.collect_list(F.struct(*_IN_CHUNK)))
    # A chunk has no more rows than positions.
    return positions.groupBy(*KEYS).agg(F.max("format").alias("format"), rows.cast(_ROWS).alias("rows"))


def to_positions(chunks: DataFrame) -> DataFrame:
    """Chunk rows back to positions."""
    return chunks.select("trajectory_id", "chunk", "format", F.inline("rows"))


class ScoreStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._manifests = f"{self.path}/manifest"

    # ---- versions -----------------------------------------------------------------------

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, by default the newest; version 0 is the empty store."""
        version = manifest.latest(self.spark, self._manifests) if version is None else version
        if not version:
            return Snapshot(0)
        found = manifest.read(self.spark, self._manifests, version)
        return Snapshot(version, tuple(found["runs"]), found["generation"], found["buckets"])

    def _commit(self, based_on: Snapshot, runs, generation, buckets) -> bool:
        content = {"runs": list(runs), "generation": generation, "buckets": buckets}
        return manifest.commit(self.spark, self._manifests, based_on.version + 1, content)

    def _run(self, run_id: str) -> str:
        return f"{self.path}/runs/{run_id}"

    def _generation(self, name: str) -> str:
        return f"{self.path}/generations/{name}"

    def leftovers(self) -> list[str]:
        """Folders that the newest version does not name: runs that died, and what was merged."""
        now = self.snapshot()
        runs = manifest.child_names(self.spark, f"{self.path}/runs")
        generations = manifest.child_names(self.spark, f"{self.path}/generations")
        return [self._run(r) for r in runs if r not in now.runs] + [
            self._generation(g) for g in generations if g != now.generation
        ]

    # ---- writing ------------------------------------------------------------------------

    def append(self, positions: DataFrame, run_id: str | None = None) -> Snapshot:
        """Write one run and commit it. ``positions`` are cache rows plus ``prompt_boundary``.

        A NULL format becomes ``logprobs``. A NULL trajectory id, or a position that occurs twice, is an
        error, and the run does not count. A run that dies leaves a folder that nothing reads.

        Rows may have a ``status`` and an ``error``: those that are not ``ok`` are written beside the
        others in the same pass and go to the quarantine.
        """
        run_id = run_id or uuid.uuid4().hex
        boundary = F.col("prompt_boundary") if "prompt_boundary" in positions.columns else F.lit(None)
        rows = positions.withColumn("prompt_boundary", boundary).withColumn("format", tag_or_default(F.col("format")))
        if "status" not in positions.columns:
            rows = rows.withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string"))
        headers, data = f"{self._run(run_id)}/headers", f"{self._run(run_id)}/positions"
        columns = [F.col(f.name).cast(f.dataType) for f in _STORED]
        rows.select(*columns, "error", "status").write.partitionBy("status").parquet(data)
        # From the files just written, so nothing is scored again.
        written = self._written(run_id)
        counted = written.groupBy("trajectory_id").agg(
            (F.max("pos") + 1).alias("seq_len"),
            F.max("format").alias("format"),
            F.max("prompt_boundary").alias("prompt_boundary"),
            (F.count("loss_mask") > 0).alias("has_loss_mask"),
            F.count(F.lit(1)).alias("_n"),
            F.min("pos").alias("_first"),
        )
        counted.withColumn("run_id", F.lit(run_id)).write.parquet(headers)
        checked = T.StructType([*CACHE_HEADERS, T.StructField("_n", T.LongType()), T.StructField("_first", T.IntegerType())])
        stored = self.spark.read.schema(checked).parquet(headers)
        # Two trajectories under one id have more rows than their positions leave room for.
        wrong = stored.where("trajectory_id IS NULL OR _n > seq_len - _first").select("trajectory_id").take(1)
        if wrong:
            raise RepeatedTrajectory(f"trajectory id {wrong[0].trajectory_id} is NULL or stands for several trajectories")
        if "status" in positions.columns:
            every = self.spark.read.schema("trajectory_id string, error string, status string").parquet(data)
            self.quarantine(every.where("status <> 'ok'").select("trajectory_id", "error"), run_id)
        while True:
            now = self.snapshot()
            if self._commit(now, [*now.runs, run_id], now.generation, now.buckets):
                return self.snapshot()

    def _written(self, run_id: str) -> DataFrame:
        """Positions of a run; none where every trajectory failed."""
        path = f"{self._run(run_id)}/positions/status=ok"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).parquet(path)

    def compact(self, buckets: int | None = None) -> Snapshot:
        """Merge all runs of the newest version into one clustered generation.

        Runs that are committed meanwhile stay runs. Readers of older versions are not disturbed.
        Without ``buckets`` there are as many as before, or as shuffle partitions, and more where a bucket
        would hold more than ``BUCKET_ENTRIES``.
        """
        before = self.snapshot()
        if not before.runs:
            return before
        name = uuid.uuid4().hex
        positions = self.positions(before)
        buckets = buckets or self._buckets(positions, before)
        # Shuffled once: positions go where the buckets of their chunks are written.
        placed = positions.repartition(buckets, *KEYS)
        write_clustered(
            to_chunks(placed), KEYS, order=KEYS, buckets=buckets,
            path=f"{self._generation(name)}/chunks", name="chunks", partitioned=True,
        )
        self.headers(before).write.parquet(f"{self._generation(name)}/headers")
        while True:
            now = self.snapshot()
            if now.generation != before.generation:
                raise RuntimeError("another compaction was faster")
            if self._commit(now, [r for r in now.runs if r not in before.runs], name, buckets):
                return self.snapshot()

    def _buckets(self, positions: DataFrame, snapshot: Snapshot) -> int:
        entries = F.sum(1 + F.greatest(F.size("top_ids"), F.lit(0)))
        (found,) = positions.agg(F.coalesce(entries, F.lit(0))).first()
        most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
        usual = snapshot.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(usual, min(-(-found // BUCKET_ENTRIES), most))

    def quarantine(self, failed: DataFrame, run_id: str) -> None:
        """Set trajectories aside with their error; the attempt counts on from earlier runs."""
        earlier = self.quarantined().groupBy("trajectory_id").agg(F.max("attempt").alias("_before"))
        attempt = (F.coalesce("_before", F.lit(0)) + 1).cast("int").alias("attempt")
        rows = failed.join(earlier, "trajectory_id", "left").select("trajectory_id", "error", attempt)
        rows.write.parquet(f"{self.path}/quarantine/run_id={run_id}")

    # ---- reading ------------------------------------------------------------------------

    def _clustered(self, snapshot: Snapshot) -> DataFrame:
        """The generation as a bucketed table of this session's catalog."""
        path = f"{self._generation(snapshot.generation)}/chunks"
        table = f"chunks_{hashlib.md5(path.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNKS)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) "
                f"INTO {snapshot.buckets} BUCKETS LOCATION '{path}'"
            )
        return self.spark.table(table)

    def _all_headers(self, snapshot: Snapshot) -> DataFrame:
        """Headers of all sources with their order; a trajectory may occur in several."""
        names = [f.name for f in CACHE_HEADERS]
        paths = [f"{self._generation(snapshot.generation)}/headers"] if snapshot.generation else [None]
        paths += [f"{self._run(r)}/headers" for r in snapshot.runs]
        found = None
        for order, path in enumerate(paths):
            if path:
                one = self.spark.read.schema(CACHE_HEADERS).parquet(path).select(*names, F.lit(order).alias("_order"))
                found = one if found is None else found.unionByName(one)
        if found is None:
            raise FileNotFoundError(f"no cached trajectories in {self.path}; append a run first")
        return found

    def headers(self, snapshot: Snapshot | None = None) -> DataFrame:
        """One header for each trajectory."""
        every = self._all_headers(snapshot or self.snapshot())
        names = [f.name for f in CACHE_HEADERS]
        first = every.groupBy("trajectory_id").agg(F.min_by(F.struct(*names[1:]), "_order").alias("h"))
        return first.select("trajectory_id", *(F.col(f"h.{n}").alias(n) for n in names[1:]))

    def positions(self, snapshot: Snapshot | None = None) -> DataFrame:
        """All positions of a version, each trajectory from the first source that has it."""
        snapshot = snapshot or self.snapshot()
        names = [f.name for f in CACHE_POSITIONS if f.name != "run_id"]
        every = self._all_headers(snapshot)
        parts = []
        if snapshot.generation:
            parts.append(to_positions(self._clustered(snapshot)).select(*names, F.lit(0).alias("_order")))
        for order, run in enumerate(snapshot.runs, 1):
            parts.append(self._written(run).select(*names, F.lit(order).alias("_order")))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        if len(parts) > 1:
            # Hardly ever any rows.
            first = every.groupBy("trajectory_id").agg(F.min("_order").alias("_first"))
            again = every.join(first, "trajectory_id").where("_order > _first").select("trajectory_id", "_order")
            found = found.join(again, ["trajectory_id", "_order"], "left_anti")
        return found.select(*names)

    def chunks(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The clustered generation; raises while there are runs to be merged."""
        snapshot = snapshot or self.snapshot()
        if not snapshot.generation or snapshot.runs:
            raise ValueError(f"{len(snapshot.runs)} runs of {self.path} are not merged; compact the store first")
        return self._clustered(snapshot)

    def quarantined(self) -> DataFrame:
        """Every failed attempt."""
        path = f"{self.path}/quarantine"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], _QUARANTINE)
        return self.spark.read.schema(_QUARANTINE).parquet(path)

    def missing(self, trajectories: DataFrame) -> DataFrame:
        """Rows whose trajectory is not in the store yet."""
        now = self.snapshot()
        if not now.version:
            return trajectories
        return trajectories.join(self.headers(now).select("trajectory_id"), "trajectory_id", "left_anti")

    def summary(self) -> DataFrame:
        """Trajectories, those without a stored loss mask, files, and their size in GB (1e9 bytes)."""
        now = self.snapshot()
        folders = [f"{self._run(r)}/positions/status=ok" for r in now.runs]
        folders += [f"{self._generation(now.generation)}/chunks"] if now.generation else []
        sizes = [n for folder in folders for n in manifest.files_below(self.spark, folder, ".parquet")]
        return self.headers(now).agg(
            F.count(F.lit(1)).alias("n_trajectories"),
            F.count_if(~F.col("has_loss_mask")).alias("n_without_mask"),
            F.lit(len(sizes)).cast("bigint").alias("n_files"),
            F.lit(sum(sizes) / 1e9).alias("total_gb"),
        )
