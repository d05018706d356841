"""Sinks: tables as parquet or JSON in a shared folder, a readable sample, and a summary as one row per figure."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S


def write_tables(folder: str, tables: dict[str, DataFrame], form: str = "parquet") -> dict[str, str]:
    """Each table as a directory of files written by the executors; gives the paths."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        df.write.mode("overwrite").format(form).save(paths[name])
    return paths


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, null members left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def rendered(calls: DataFrame, most: int = 6) -> DataFrame:
    """The first calls as text, one line a turn."""
    line = lambda t: F.concat(F.lit("["), S.clock(F.coalesce(t["t"], F.lit(0))), F.lit("] "), F.coalesce(t["speaker"], F.lit("?")), F.lit(": "), F.coalesce(t["text"], F.lit("")))
    return calls.orderBy("pos", "call_id").limit(most).select("call_id", F.array_join(F.transform("turns", line), "\n").alias("text"))


def summary(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares by one column."""
    from pyspark.sql import Window

    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def highlighted(text, quote):
    """The text with the quote between marks, as it is where the quote isn't in it."""
    at = F.position(quote, text)
    return F.when((at > 0) & (F.length(quote) > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit("**"), quote, F.lit("**"), F.substring(text, at + F.length(quote), F.length(text)))).otherwise(text)
