"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.storage import cut


def row_numbers(rows: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """The rows with their number (from 1) within their key's order, without bringing a key's rows together.

    Rows are dealt out by ranges of key and order, so a large key spans many ranges; each range numbers its own rows, and starts from
    how many of the key's rows the ranges before it have.  Ties are broken anyhow, so the order should end in a unique column.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    own = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(starts, same).select(*rows.columns, (F.col("_row") + F.col("_before")).cast("bigint").alias(name))
