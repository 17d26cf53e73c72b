from pyspark.sql import functions as F

from tracemill import fixtures as fx


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    """Cut into many splits, all its rows lie in one of them."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in small}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        table = fx.table(spark, str(tmp_path), "documents")
        sizes = [r["count"] for r in table.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(sizes) == 20_000
    assert len(sizes) >= spark.sparkContext.defaultParallelism
    assert max(sizes) < 20_000 / 4
