"""Session settings and the shared folder for tables written half-way through a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app: str = "tracemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    The number of shuffle partitions is left to the cluster (AQE coalesces it); tests and the
    benchmark pass their own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Texts grow a lot when they are cut into tokens, so small shuffles stay spread out.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        # Samples are collected per trajectory; a buffer holds at most max_tokens numbers.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of the machine.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every node can reach")
        if sc.applicationId not in _LOCAL_DIRS:
            _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="tracemill-")
        base = _LOCAL_DIRS[sc.applicationId]
    return f"{base.rstrip('/')}/tracemill-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, and pins rows whose values depend on where they were computed (partition
    numbers), so that a lost executor cannot change them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Within it, a task that writes by a column keeps a file open for each of up to ``most`` values.

    Without it Spark sorts all rows of a task by that column first. Rows of further values are sorted as ever.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def join_files(spark: SparkSession, source: str, target: str) -> None:
    """The Parquet files of each folder of ``source`` as one file in the folder of that name in ``target``.

    Row groups are copied as bytes, neither decoded nor held. ``source`` is deleted then.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path, parquet = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.parquet.hadoop
    fs = path(source).getFileSystem(conf)
    fs.mkdirs(path(target))
    for folder in fs.listStatus(path(source)):
        if not folder.isDirectory():
            continue
        names = sorted(f.getPath().toString() for f in fs.listStatus(folder.getPath()))
        files = [parquet.util.HadoopInputFile.fromPath(path(n), conf) for n in names if n.endswith(".parquet")]
        if not files:
            continue
        reader = parquet.ParquetFileReader.open(files[0])
        described = reader.getFileMetaData()
        reader.close()
        joined = path(f"{target}/{folder.getPath().getName()}/part-{uuid.uuid4().hex}.parquet")
        writer = parquet.ParquetFileWriter(conf, described.getSchema(), joined)
        writer.start()
        for file in files:
            writer.appendFile(file)
        writer.end(described.getKeyValueMetaData())
    fs.delete(path(source), True)
