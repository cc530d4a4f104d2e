"""Running sums and ranks over a total order without one task holding it.

Rows are dealt by range, written once so that the deal is fixed, and summed in
two levels: inside a range by a window, over ranges by a window on their totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.session import written


def running_sum(df: DataFrame, order: list, value: Column, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in ``order``, of the same ``by`` columns."""
    by = by or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("__v", value).repartitionByRange(n, *by, *order).withColumn("__p", F.spark_partition_id())
    rows = written(rows, "ordered")
    totals = rows.groupBy("__p", *by).agg(F.sum("__v").alias("__t"))
    upto = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__b", F.coalesce(F.sum("__t").over(upto), F.lit(0))).drop("__t")
    keys = totals.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(["__p", *by])], "__b")
    same = F.lit(True)
    for i, c in enumerate(["__p", *by]):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(keys) if n <= 10_000 and not by else keys, same)
    rows = rows.withColumn(out, F.col("__b") + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return rows.drop("__v", "__p", "__b", *[f"__k{i}" for i in range(len(by) + 1)])


def row_number(df: DataFrame, order: list, out: str, by: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the place of the row, from 1."""
    return running_sum(df, order, F.lit(1).cast("long"), out, by).withColumn(out, F.col(out) + 1)


def running_sum_by_digest(df: DataFrame, digest: str, value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows with smaller hex digests.

    Digests are uniform, so their first four characters are 65,536 even
    buckets: no rows are written and the windows hold one bucket, or the
    totals of all.
    """
    rows = df.withColumn("__v", value).withColumn("__h", F.substring(digest, 1, 4))
    totals = rows.groupBy("__h").agg(F.sum("__v").alias("__t"))
    upto = Window.partitionBy(F.lit(0)).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("__h"), F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__h").orderBy(digest).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(totals), "__h")  # 65,536 rows at most
    return rows.withColumn(out, F.col("__b") + F.coalesce(F.sum("__v").over(inside), F.lit(0))).drop("__v", "__h", "__b")
