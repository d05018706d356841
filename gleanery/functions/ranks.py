"""Exact ranks over any number of values, without a sort of all of them in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.common import durable


def running_counts(values: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, order, n, upto, total): per distinct value its count and the count up to it, by key.

    Values are range-partitioned, so a key with most of the rows is spread over partitions; offsets of the
    partitions are added up over a table of one row per key and partition. Null keys are a key; null values come first.
    """
    counted = values.groupBy(*keys, *order).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    parts = durable(counted.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    by_part = parts.groupBy(*keys, "_part").agg(F.sum("n").alias("_n"))
    all_ = Window.partitionBy(*keys)
    before = F.sum("_n").over(all_.orderBy("_part")) - F.col("_n")
    offsets = by_part.select(*keys, "_part", before.alias("_before"), F.sum("_n").over(all_).alias("total"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "_part"]]
    joined = parts.alias("p").join(offsets.alias("o"), same).select("p.*", "o._before", "o.total")
    upto = F.sum("n").over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("upto", upto + F.col("_before")).select(*keys, *order, "n", "upto", "total")


def nearest_rank(values: DataFrame, keys: list[str], value: str, quantiles: dict[str, tuple[int, int]]) -> DataFrame:
    """Per key the value at the 0-based place min(n - 1, floor(q * n)), q given as a fraction (numerator, denominator); and n."""
    runs = running_counts(values.where(F.col(value).isNotNull()), keys, [value])
    at = lambda a, b: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.expr(f"total * {a} div {b}")), F.col(value)))
    return runs.groupBy(*keys).agg(F.max("total").alias("n"), *(at(*q).alias(name) for name, q in quantiles.items()))
