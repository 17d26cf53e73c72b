"""The archive source: round trips, partitions by size, pruned arrays, archives of other writers."""

import numpy as np
import pytest

from tracemill.session import fresh_path
from tracemill.sources import npz_source
from tracemill.sources.npz import IMPORT_SCHEMA, read_npz_cache


def rows_of(name, length, boundary=3, tag="logits", mask=True):
    return [
        (f"trajectory_{name}", p // 1024, p, p % 9, p % 2 if mask else None, boundary, tag, [p % 5, 7], [-0.5 * (p % 4), -2.25])
        for p in range(length)
    ]


def collected(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip(spark):
    rows = rows_of("a", 2500) + rows_of("b", 1, tag=None) + rows_of("c/d é", 1024, boundary=None, mask=False)
    folder = fresh_path(spark, "archives")
    df = spark.createDataFrame([(r[0].removeprefix("trajectory_"), *r[1:]) for r in rows], IMPORT_SCHEMA).repartition(7)
    npz_source.write_npz(df, folder)
    back = npz_source.read_npz(spark, folder)
    want = sorted((r[0].replace("c/d é", "c%2Fd%20%C3%A9"), *r[1:]) for r in rows)
    assert list(map(str, collected(back))) == list(map(str, want))
    # The other importer reads the same archives.
    assert read_npz_cache(spark, folder).count() == len(rows)
    # Written again, by a task that runs twice: nothing doubles.
    npz_source.write_npz(df, folder)
    assert npz_source.read_npz(spark, folder).count() == len(rows)


def test_partitions_by_size(spark):
    assert npz_source.pack([("a", 5), ("b", 5), ("c", 1), ("d", 30), ("e", 1)], 10) == [("a", "b"), ("c",), ("d",), ("e",)]
    folder = fresh_path(spark, "archives")
    npz_source.write_npz(spark.createDataFrame([r for k in range(9) for r in rows_of(k, 40)], IMPORT_SCHEMA), folder)
    assert npz_source.read_npz(spark, folder, partition_bytes=1).rdd.getNumPartitions() == 9
    assert npz_source.read_npz(spark, folder).rdd.getNumPartitions() == 1


def test_only_wanted_arrays_are_unpacked(spark, tmp_path):
    """An archive without scores, with the batch dimension of some writers, and a short mask."""
    np.savez(tmp_path / "trajectory_x.npz", input_ids=np.arange(5)[None, :], loss_mask=np.ones(2, np.int64))
    np.savez(tmp_path / "other.npz", input_ids=np.arange(3))
    rows = npz_source.read_npz(spark, str(tmp_path), ["trajectory_id", "pos", "token_id", "loss_mask", "format", "prompt_boundary"])
    assert collected(rows) == [("trajectory_x", p, p, int(p < 2), None, None) for p in range(5)]
    with pytest.raises(Exception, match="values|not a file"):
        npz_source.read_npz(spark, str(tmp_path), ["pos", "top_vals"]).collect()


def test_unscored_end_is_null(spark, tmp_path):
    np.savez(
        tmp_path / "trajectory_y.npz", input_ids=np.arange(3), values=np.ones((2, 2), np.float16), indices=np.zeros((2, 2), np.int32)
    )
    got = collected(npz_source.read_npz(spark, f"file:{tmp_path}", ["pos", "top_ids", "top_vals"]))
    assert got == [(0, [0, 0], [1.0, 1.0]), (1, [0, 0], [1.0, 1.0]), (2, None, None)]


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="no cached trajectories"):
        npz_source.read_npz(spark, str(tmp_path)).collect()
