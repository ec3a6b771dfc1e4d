"""Rows of a group in order, when one group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Groups are cut only above this many rows, and above one in SHARE of all rows; so less than SHARE groups are.
LEAST, SHARE = 4096, 10_000


def cut_groups(rows: DataFrame, key: str, order: list[Column], piece: str = "piece", least: int = LEAST) -> DataFrame:
    """rows with a column `piece`: within a key, all rows of a piece come before those of a higher piece in `order`.

    A key with up to `least` rows, or with up to one in SHARE of all rows, is one piece, 0. Larger ones, less than SHARE, are dealt over
    tasks by range at splitters that Spark samples, rows that tie too; what lies in one range is a piece, from 1 on. `order` gives null its place. A
    null key is a key like others. The cut depends on the sample, so results must not depend on where it falls.
    """
    count = rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    large = [r[0] for r in count.filter(F.col("n") > max(least, total // SHARE)).select(key).collect()]  # less than SHARE keys
    if not large:
        return rows.withColumn(piece, F.lit(0))
    spark = rows.sparkSession
    mark, tie = free_names([*rows.columns, piece], "large", "tie")
    side = F.broadcast(spark.createDataFrame([(k,) for k in large], rows.select(F.col(key).alias(mark)).schema).withColumn(tie, F.lit(True)))
    marked = rows.join(side, F.col(key).eqNullSafe(F.col(mark)), "left").drop(mark)
    rest = marked.filter(F.col(tie).isNull()).drop(tie).withColumn(piece, F.lit(0))
    hot = marked.filter(F.col(tie)).withColumn(tie, F.monotonically_increasing_id())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // max(1, least) + 1)
    hot = hot.repartitionByRange(n, F.col(key).asc_nulls_first(), *order, F.col(tie)).withColumn(piece, F.spark_partition_id() + 1).drop(tie)
    return rest.unionByName(hot)
