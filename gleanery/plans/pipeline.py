"""The whole run: read cells out of calls, check them, mine what is resolved, and report; each stage a table in a folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.common import durable, stored, table
from gleanery.functions import scalars as S
from gleanery.operators import activation, detect, funnel, mining
from gleanery.operators import cells as C
from gleanery.operators.grounding import checked
from gleanery.sources.files import write_tables


def run(spark, sf_dir: str, folder: str | None = None) -> dict[str, DataFrame]:
    """Tables cells, budget, validated, hypotheses, signals and summary; written below folder if one is given.

    The second reader is detect.reread and the repair what it reads, so nothing of the recorded verdicts is used.
    """
    fields, calls_ = table(spark, sf_dir, "schema_fields"), C.calls(spark, sf_dir)
    order = fields.select("field", "field_ord")
    cues = durable(detect.cue_table(detect.cue_lines(spark, sf_dir)))
    # a call's texts meet its cells in its own row and end there
    texts = F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: S.normalized(F.coalesce(t, F.lit(""))))
    said = detect.call_texts(spark, sf_dir)
    x = detect.read_calls(said.withColumn("normal", texts), cues, fields).join(F.broadcast(order), "field").drop("strength", "margin", "texts").withColumnRenamed("normal", "texts")
    x = checked(x.withColumn("turn_words", F.lit(None)), fields, split=False).withColumn("quote", F.get("evidence", F.lit(0))["quote"]).withColumn("text", F.col("quote"))
    x = detect.reread(x.drop("captured_at", "asr_confidence"), cues).drop("quote", "text")
    x = x.withColumn("rejects", F.coalesce((F.size("evidence") > 0) & (F.col("value") != "false") & (F.col("verdict") == "reject"), F.lit(False))).withColumn("fixed", F.when(F.col("rejects"), F.col("corrected")))
    x = stored(x.withColumn("repair_holds", F.col("fixed").isNotNull()).drop("verdict", "corrected"))
    cells_ = x.select("call_id", "pos", "stratum", "field", "field_ord", "value", "confidence", "evidence")
    x = funnel.eligible(x, calls_)
    budget = durable(funnel.budgets(x, None))
    v = funnel.routed(x, budget, None).withColumn("value", F.when(F.col("settled") == "repaired", F.col("fixed")).otherwise(F.col("value"))).withColumn("disposition", F.col("settled"))
    v = stored(v.select("call_id", "pos", "stratum", "field", "field_ord", "value", "confidence", "evidence", "route", "decided_by", "disposition", "tries"))
    rows = C.bucketed(C.resolved(v), calls_, fields)
    found, tests = mining.findings(rows, calls_)
    found = durable(found)
    out = {"cells": cells_, "budget": budget, "validated": v, "hypotheses": found, "signals": activation.signals(found)}
    counts = v.groupBy(F.concat_ws(".", F.lit("route"), "route", "disposition").alias("figure")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.unionByName(tests.select(F.lit("hypotheses tested").alias("figure"), F.col("tests").alias("n")).groupBy("figure").agg(F.sum("n").alias("n")))
    out["summary"] = counts.unionByName(found.groupBy(F.concat_ws(".", F.lit("verdict"), "verdict").alias("figure")).agg(F.count(F.lit(1)).alias("n")))
    if folder:
        write_tables(folder, out)
    return out


def q_pipeline(spark, sf_dir):
    return run(spark, sf_dir)["summary"]


def q_pipeline_signals(spark, sf_dir):
    return run(spark, sf_dir)["signals"]


def q_corpus(spark, sf_dir):
    from gleanery.sources.corpus import corpus

    return corpus(spark, 240).drop("turns")


QUERIES = {"pipeline_end_to_end": q_pipeline, "pipeline_signals": q_pipeline_signals, "corpus_generate": q_corpus}
SQL: dict[str, str] = {}
