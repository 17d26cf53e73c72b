import pytest
from pyspark.sql import functions as F

from tracemill.sources.trajectories import require_ids, split_by_id


def rows(spark, ids):
    return spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "trajectory_id string, n int")


def test_split_keeps_every_row(spark):
    sound, faulty = split_by_id(rows(spark, ["a", None, "b", "c", "b", None, "", "b"]))
    assert sorted(r.trajectory_id for r in sound.collect()) == ["", "a", "c"]
    assert sound.columns == ["trajectory_id", "n"]
    found = sorted((r.n, r.id_fault) for r in faulty.collect())
    assert found == [(1, "missing"), (2, "repeated"), (4, "repeated"), (5, "missing"), (7, "repeated")]


def test_one_frequent_id(spark):
    sound, faulty = split_by_id(spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("trajectory_id")
    ))
    assert (sound.count(), faulty.count()) == (13_333, 6_667)


def test_empty(spark):
    sound, faulty = split_by_id(rows(spark, ["x"]).where("false"))
    assert (sound.count(), faulty.count()) == (0, 0)


@pytest.mark.parametrize("ids, word", [(["a", None], "missing"), (["a", "b", "a"], "repeated")])
def test_required(spark, ids, word):
    with pytest.raises(Exception, match=word):
        require_ids(rows(spark, ids)).collect()


def test_required_passes_sound_rows(spark):
    assert require_ids(rows(spark, ["a", "b"])).count() == 2


def test_frequent_ids_are_not_shuffled(spark, tmp_path):
    """Rows that share an id, and rows without one, stay where they are."""
    key = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    spark.range(40_000).repartition(8).select(key.alias("trajectory_id"), "id").write.parquet(f"{tmp_path}/rows")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # A table of ids too wide to be broadcast as a whole, as in a large corpus.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, faulty = split_by_id(spark.read.parquet(f"{tmp_path}/rows"))
        sizes = {}
        for r in faulty.groupBy(F.spark_partition_id().alias("p"), "id_fault").count().collect():
            sizes.setdefault(r.id_fault, []).append(r["count"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    missing, hot = -(-40_000 // 7), -(-40_000 // 3) - -(-40_000 // 21)
    assert (sum(sizes["missing"]), sum(sizes["repeated"])) == (missing, hot)
    assert max(sizes["missing"]) < missing / 3
    assert max(sizes["repeated"]) < hot / 3
