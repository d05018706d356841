"""Ranked findings as signals: a sentence, a metric, a severity by size, and the calls behind each."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

from . import cells as C
from . import mining as M


def humanised(c):
    return F.regexp_replace(c, "_", " ")


def percent(c):
    return F.concat(F.format_string("%.1f", F.round(c * 100, 1)), F.lit("%"))


def signals(found: DataFrame, most: int = M.MAX_SIGNALS) -> DataFrame:
    """(position, id, title, finding, severity, metric_value, metric_baseline) of the first findings."""
    x = M.ranked(found).where((F.col("verdict") == "finding") & (F.col("position") <= most))
    cond = F.when(F.col("family") == "trend", F.lit("in the later half")).otherwise(F.concat(F.lit("with "), humanised(F.col("cond_field")), F.lit(" "), humanised(F.col("cond_value"))))
    out = F.concat(humanised(F.col("out_field")), F.lit(" "), humanised(F.col("out_value")))
    text = F.concat(F.lit("Calls "), cond, F.lit(" have "), out, F.lit(" in "), percent(F.col("conditional_rate")), F.lit(" of "), F.col("n").cast("string"), F.lit(" cases, against "), percent(F.col("baseline_rate")), F.lit("."))
    size = F.when((F.col("lift") >= 2) & (F.col("n") >= 15), "high").when(F.col("lift") >= 2, "medium").otherwise("low")
    return x.select("position", S.slug(F.concat_ws("-", "cond_field", "cond_value", "out_field", "out_value")).alias("id"), S.shortened(F.concat(out, F.lit(" "), cond)).alias("title"), text.alias("finding"), size.alias("severity"), percent(F.col("conditional_rate")).alias("metric_value"), percent(F.col("baseline_rate")).alias("metric_baseline"))


def q_signals(spark, sf_dir):
    return signals(M.findings(C.analysis_rows(spark, sf_dir), C.calls(spark, sf_dir))[0])


def q_expected_false_findings(spark, sf_dir):
    n = q_signals(spark, sf_dir).agg(F.count(F.lit(1)).alias("signals"))
    return n.withColumn("expected_false", F.round(F.col("signals") * M.FDR_Q, 6))


_P = "format('{{:.1f}}%', round({} * 100, 1))"
_H = "replace({}, '_', ' ')"
_COND = f"case when family = 'trend' then 'in the later half' else 'with ' || {_H.format('cond_field')} || ' ' || {_H.format('cond_value')} end"
_OUT = f"{_H.format('out_field')} || ' ' || {_H.format('out_value')}"
_TITLE = f"({_OUT} || ' ' || {_COND})"
_SIG = f"""with {C.ROWS_CTE}, {M._CHECKED}, ps as (select *, row_number() over (order by verdict = 'finding' desc, round(q_value, 12), round(lift, 9) desc, place) position from checked), sg as (
select position, regexp_replace(regexp_replace(lower(cond_field || '-' || cond_value || '-' || out_field || '-' || out_value), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') id,
  case when length({_TITLE}) > 60 then left({_TITLE}, 60) || '…' else {_TITLE} end title,
  'Calls ' || {_COND} || ' have ' || {_OUT} || ' in ' || {_P.format('conditional_rate')} || ' of ' || n::bigint || ' cases, against ' || {_P.format('b')} || '.' finding,
  case when lift >= 2 and n >= 15 then 'high' when lift >= 2 then 'medium' else 'low' end severity, {_P.format('conditional_rate')} metric_value, {_P.format('b')} metric_baseline
from ps where verdict = 'finding' and position <= 8)"""
QUERIES = {"signals": q_signals, "expected_false_findings": q_expected_false_findings}
SQL = {"signals": f"{_SIG} select * from sg", "expected_false_findings": f"{_SIG} select count(*) signals, round(count(*) * 0.05, 6)::double expected_false from sg"}
