"""Dense numbers in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: str, path: str, weight: str | None = None, start: int = 1) -> DataFrame:
    """Adds __seq (position from `start` by ascending key) and, with a weight, __base (sum of the weights before).

    Rows are dealt by ranges of key and written once below `path`, so that both passes see one partitioning; the
    driver sees two sums a partition.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    w = F.col(weight) if weight else F.lit(0)
    sums = {r["__part"]: (r.c, r.s) for r in rows.groupBy("__part").agg(F.count(F.lit(1)).alias("c"), F.sum(w).alias("s")).collect()}
    table, count, total = [], start - 1, 0
    for part in sorted(sums):
        table.append((part, count, total))
        count, total = count + sums[part][0], total + (sums[part][1] or 0)
    before = spark.createDataFrame(table, "__part int, __count bigint, __sum bigint")
    by = Window.partitionBy("__part").orderBy(key)
    out = rows.withColumn("__row", F.row_number().over(by)).withColumn("__within", F.sum(w).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.join(before, "__part").withColumn("__seq", (F.col("__row") + F.col("__count")).cast("bigint")).withColumn("__base", (F.coalesce("__within", F.lit(0)) + F.col("__sum")).cast("bigint"))
    return out.drop("__part", "__row", "__within", "__count", "__sum")
