"""Spans as a stream: rollups per agent and window with late rows, and calibration counts kept up to date."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import folded

LATE = "2 days"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share; on one machine, where none is set, a folder of this machine."""
    import uuid

    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="gleanery")
    return f"{base}/stream-{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream, or a single such file by its folder and name."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def span_windows(spans: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts, failures and token sums per agent and window of received_at, each span id once within the watermark."""
    s = spans.withColumn("agent", folded("agent")).withWatermark("received_at", LATE).dropDuplicatesWithinWatermark(["id"])
    return s.groupBy(F.window("received_at", width), "agent").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")
    )


def calibration_counts(cells: DataFrame) -> DataFrame:
    """Second readings and rejections per field, updated as cells arrive."""
    v = cells.select("field", F.explode("verdicts").alias("v")).where("v.decided_by = 'critic'")
    return v.groupBy("field").agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.col("v.verdict") == "reject").alias("rejects"))


def settled(stream: DataFrame, keys: list[str], state: str | None = None) -> DataFrame:
    """Runs a stream to the end of what is there; per key the row of the last batch. Batches are written once each, so a repeated one changes nothing."""
    spark = stream.sparkSession
    state = state or shared_folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{state}/rows/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{state}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, _batch int").parquet(f"{state}/rows/*")
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_batch").desc())))
    return last.where("_r = 1").drop("_r", "_batch")


def q_stream_rollup(spark, sf_dir):
    x = settled(span_windows(read_stream(spark, f"{sf_dir}/spans.parquet")), ["window", "agent"])
    return x.select(F.col("window.start").alias("window_start"), "agent", "calls", "failures", "input_tokens", "output_tokens")


def q_stream_calibration(spark, sf_dir):
    return settled(calibration_counts(read_stream(spark, f"{sf_dir}/validated_cells.parquet")), ["field"])


QUERIES = {"stream_rollup": q_stream_rollup, "stream_calibration": q_stream_calibration}
SQL = {"stream_calibration": "select field, count(*) reads, count(*) filter (v.verdict = 'reject') rejects from (select field, unnest(verdicts) v from validated_cells) where v.decided_by = 'critic' group by 1"}
