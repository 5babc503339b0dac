"""Running totals and exact medians of groups of any size, and size-checked broadcasts.

A window over one huge group is one task. Here rows are range-sorted by group and order
first, so that a huge group lies in many partitions; each part's total comes before the
parts behind it, and a window runs within a part alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import cut

#: Rows up to which a table is sent to every executor.
SMALL_ROWS = 100_000


def small(df: DataFrame, most_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a table of its own, marked for broadcast if it has at most ``most_rows`` rows."""
    table = cut(df, "small")
    return F.broadcast(table) if table.count() <= most_rows else table


def running(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column | int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys up to and with this one; with value 1, the row's number.

    ``order`` must be total within the keys for the result to be defined row by row.
    """
    by = [*keys, *order]
    value = value if isinstance(value, Column) else F.lit(value)
    placed = cut(rows.orderBy(*by).withColumn("_part", F.spark_partition_id()), "sorted")
    parts = placed.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")), "base")
    same = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(within) + F.col("_base")
    return placed.join(base, same).withColumn(name, total).drop("_part", "_p", "_base", *(f"_k{i}" for i in range(len(keys))))


def medians(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """(key, mid, n): the exact median of ``value`` and the number of rows of each key."""
    numbered = running(rows.select(key, value, tie), [key], [value, tie], 1, "_at")
    counted = numbered.join(small(rows.groupBy(key).agg(F.count("*").alias("n"))), key)
    middle = (F.col("_at") == F.floor((F.col("n") + 1) / 2)) | (F.col("_at") == F.ceil((F.col("n") + 1) / 2))
    return counted.where(middle).groupBy(key).agg(F.avg(value).alias("mid"), F.first("n").alias("n"))
