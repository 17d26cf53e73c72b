"""Tables that are stored hash-partitioned by key, so that later joins on the key do not move them."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tracemill.session import fresh_path


def write_clustered(
    df: DataFrame,
    keys: Sequence[str],
    *,
    order: Sequence[str] = (),
    buckets: int | None = None,
    path: str | None = None,
    name: str = "clustered",
    partitioned: bool = False,
) -> DataFrame:
    """Write ``df`` in buckets of ``keys``, sorted by ``order`` inside, and return the table.

    A join or aggregation on ``keys`` reads it without an exchange. There are as many buckets as
    shuffle partitions unless ``buckets`` says otherwise; the other side of a join is shuffled into
    the same number. Files lie in ``path``, or else in a new folder of the shared directory.
    ``partitioned`` says that ``df`` comes from ``repartition(buckets, *keys)`` already.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    # Partitioned like the buckets, so that each task writes whole buckets: one file for each.
    rows = df if partitioned else df.repartition(buckets, *keys)
    writer = rows.write.format("parquet").bucketBy(buckets, *keys)
    if order:
        writer = writer.sortBy(*order)
    writer.option("path", path or fresh_path(spark, name)).saveAsTable(table)
    return spark.table(table)
