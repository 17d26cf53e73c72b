"""Versioned manifests: small JSON files that name what a table consists of.

A version is committed by renaming a finished file to the next number, which fails if another
writer was first. Readers list the folder and take the highest number, so they see a whole version
or the one before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tracemill.session import path_exists


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _file(folder: str, version: int) -> str:
    return f"{folder}/v{version:010d}.json"


def child_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of a folder, none if it does not exist."""
    if not path_exists(spark, folder):
        return []
    return sorted(status.getPath().getName() for status in _fs(spark, folder).listStatus(_path(spark, folder)))


def files_below(spark: SparkSession, folder: str, suffix: str) -> list[int]:
    """Sizes of the files below a folder whose names end in ``suffix``."""
    if not path_exists(spark, folder):
        return []
    found, sizes = _fs(spark, folder).listFiles(_path(spark, folder), True), []
    while found.hasNext():
        status = found.next()
        if status.getPath().getName().endswith(suffix):
            sizes.append(status.getLen())
    return sizes


def latest(spark: SparkSession, folder: str) -> int:
    """The highest committed version, 0 if there is none."""
    numbers = [int(n[1:-5]) for n in child_names(spark, folder) if n.startswith("v") and n.endswith(".json")]
    return max(numbers, default=0)


def read(spark: SparkSession, folder: str, version: int) -> dict:
    stream = _fs(spark, folder).open(_path(spark, _file(folder, version)))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> bool:
    """Make ``content`` that version; False if the version exists already."""
    jvm = spark._jvm
    fs, target = _fs(spark, folder), _path(spark, _file(folder, version))
    unfinished = _path(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(unfinished, False)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(unfinished, target, no_options)
    except Exception as problem:
        fs.delete(unfinished, False)
        if fs.exists(target):
            return False
        raise problem
    return True
