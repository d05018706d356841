"""The long table of cells, its buckets, domains and counts: what mining stands on.

A cell is one value of one field of one call. Repeated deliveries are one cell, as first loaded; a call delivered twice is one
call. A cell is resolved if it was accepted or repaired (labels folded, "-" as "_") and has a value.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import folded, table
from gleanery.functions.ranks import nearest_rank

MIN_VALUE, MIN_TERCILE = 6, 18
LABELS = {"number": ("low", "mid", "high"), "date": ("near", "mid", "far")}


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, pos, stratum, captured_at, duration_sec, asr_confidence), one row per call, calls without any cell included."""
    t = table(spark, sf_dir, "transcripts").where("call_id is not null")
    return t.groupBy("call_id").agg(F.min_by(F.struct("pos", "stratum", "captured_at", "duration_sec", "asr_confidence"), F.struct("ingested_at", "pos")).alias("c")).select("call_id", "c.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, field, and the rest of a cell), one row per call and field."""
    v = table(spark, sf_dir, "validated_cells").where("call_id is not null and field is not null")
    rest = ("pos", "stratum", "field_ord", "value", "confidence", "evidence", "disposition", "attempts", "verdicts")
    first = v.groupBy("call_id", "field").agg(F.min_by(F.struct(*rest), F.struct("load_no", "loaded_at")).alias("c")).select("call_id", "field", "c.*")
    return first.withColumn("disposition", F.regexp_replace(folded("disposition"), "-", "_"))


def resolved(cells_: DataFrame) -> DataFrame:
    return cells_.where(F.col("disposition").isin("accepted", "repaired") & F.col("value").isNotNull()).select("call_id", "stratum", "field", "field_ord", "value")


def measured(rows: DataFrame, calls_: DataFrame, fields: DataFrame) -> DataFrame:
    """Resolved cells with the measure to be bucketed: the number itself, or the days from the call to the date; null where there is none."""
    types = fields.select("field", F.col("type").alias("_type"))
    x = rows.join(types, "field", "left").join(calls_.select("call_id", "captured_at"), "call_id", "left")
    number, day = F.expr("try_cast(value as double)"), F.expr("try_cast(value as date)")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return x.withColumn("measure", F.when((F.col("_type") == "number") & finite, number).when(F.col("_type") == "date", F.datediff(day, "captured_at").cast("double")))


def tercile_cuts(m: DataFrame) -> DataFrame:
    """(field, n, lo, hi): the measures at places n div 3 and 2n div 3."""
    return nearest_rank(m.where("measure is not null"), ["field"], "measure", {"lo": (1, 3), "hi": (2, 3)})


def bucketed(rows: DataFrame, calls_: DataFrame, fields: DataFrame) -> DataFrame:
    """Resolved cells with numbers as low, mid, high and dates as near, mid, far.

    Ties stay together. A field with fewer than 18 measures keeps its raw values; one whose cuts fall together loses its
    measured cells; a value that is no measure stays raw.
    """
    m = measured(rows, calls_, fields)
    x = m.join(tercile_cuts(m), "field", "left")
    third = F.when(F.col("measure") < F.col("lo"), 0).when(F.col("measure") < F.col("hi"), 1).otherwise(2)
    label = F.when(F.col("_type") == "number", F.element_at(F.array(*map(F.lit, LABELS["number"])), third + 1)).otherwise(F.element_at(F.array(*map(F.lit, LABELS["date"])), third + 1))
    use = F.col("measure").isNotNull() & (F.col("n") >= MIN_TERCILE)
    return x.where(~use | F.col("n").isNull() | (F.col("lo") < F.col("hi"))).withColumn("value", F.when(F.coalesce(use, F.lit(False)), label).otherwise(F.col("value"))).select("call_id", "stratum", "field", "field_ord", "value")


def value_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def analysis_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(resolved(cells(spark, sf_dir)), calls(spark, sf_dir), table(spark, sf_dir, "schema_fields"))


def q_cells_resolved(spark, sf_dir):
    return resolved(cells(spark, sf_dir)).select("call_id", "field", "value")


def q_tercile_cuts(spark, sf_dir):
    return tercile_cuts(measured(resolved(cells(spark, sf_dir)), calls(spark, sf_dir), table(spark, sf_dir, "schema_fields")))


def q_analysis_rows(spark, sf_dir):
    return analysis_rows(spark, sf_dir).select("call_id", "field", "value")


def q_value_domains(spark, sf_dir):
    return value_counts(analysis_rows(spark, sf_dir)).where(F.col("n") >= MIN_VALUE)


def q_rare_values_dropped(spark, sf_dir):
    return value_counts(analysis_rows(spark, sf_dir)).where(F.col("n") < MIN_VALUE).groupBy("field").agg(F.count(F.lit(1)).alias("dropped"))


def q_observation_counts(spark, sf_dir):
    return analysis_rows(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def q_cells_pivot(spark, sf_dir):
    """One row per call, one column per field of the schema (a table of settings); cells in human review are masked."""
    c = cells(spark, sf_dir).withColumn("value", F.when(F.col("disposition") != "human_review", F.col("value")))
    fields = [r["field"] for r in table(spark, sf_dir, "schema_fields").select("field", "field_ord").distinct().orderBy("field_ord").collect()]
    return c.groupBy("call_id").pivot("field", fields).agg(F.first("value"))


def q_cells_unpivot(spark, sf_dir):
    """Wide gold codes as long rows; repeated rows once, blanks are no value."""
    g = table(spark, sf_dir, "gold").where("call_id is not null")
    wide = g.select("call_id", *(folded(c).alias(c) for c in ("reason", "product_line", "outcome", "objection", "competitor", "sentiment")))
    return wide.unpivot(["call_id"], [c for c in wide.columns if c != "call_id"], "field", "value").where("value <> ''").distinct()


def q_corpus_stats(spark, sf_dir):
    t = table(spark, sf_dir, "transcripts").where("call_id is not null").groupBy("call_id").agg(F.min_by(F.struct("stratum", "turns", "asr_confidence"), F.struct("ingested_at", "pos")).alias("c")).select("c.*")
    return t.groupBy("stratum").agg(F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.size("turns")), 6).alias("avg_turns"), F.round(F.avg("asr_confidence"), 6).alias("avg_confidence"))


def q_disposition_histogram(spark, sf_dir):
    n = cells(spark, sf_dir).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


FOLD = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
CALLS_CTE = "calls as (select call_id, x.* from (select call_id, arg_min({'pos': pos, 'stratum': stratum, 'captured_at': captured_at, 'duration_sec': duration_sec, 'asr_confidence': asr_confidence, 'turns': turns}, (ingested_at, pos)) x from transcripts where call_id is not null group by 1))"
CELLS_CTE = f"""cells as (select call_id, field, x.pos, x.stratum, x.field_ord, x.value, x.confidence, x.evidence, replace({FOLD.format('x.disposition')}, '-', '_') disposition, x.attempts, x.verdicts
  from (select call_id, field, arg_min({{'pos': pos, 'stratum': stratum, 'field_ord': field_ord, 'value': value, 'confidence': confidence, 'evidence': evidence, 'disposition': disposition, 'attempts': attempts, 'verdicts': verdicts}}, (load_no, loaded_at)) x
  from validated_cells where call_id is not null and field is not null group by 1, 2))"""
ROWS_CTE = f"""{CALLS_CTE}, {CELLS_CTE}, resolved as (select * from cells where disposition in ('accepted', 'repaired') and value is not null
), measured as (
  select r.*, s.type, case when s.type = 'number' and isfinite(try_cast(r.value as double)) then try_cast(r.value as double) when s.type = 'date' then (try_cast(r.value as date) - c.captured_at)::double end measure
  from resolved r left join schema_fields s on s.field = r.field left join calls c on c.call_id = r.call_id
), placed as (select field, measure, row_number() over (partition by field order by measure) - 1 place, count(*) over (partition by field) n from measured where measure is not null
), cuts as (select field, any_value(n) n, max(measure) filter (place = n // 3) lo, max(measure) filter (place = 2 * n // 3) hi from placed group by 1
), rows as (
  select m.call_id, m.stratum, m.field, m.field_ord, case when m.measure is null or c.n < 18 then m.value when m.measure < c.lo then case type when 'number' then 'low' else 'near' end when m.measure < c.hi then 'mid' else case type when 'number' then 'high' else 'far' end end as value
  from measured m left join cuts c on c.field = m.field where m.measure is null or c.n < 18 or c.lo < c.hi
), vc as (select field, value, count(*) n from rows group by 1, 2)"""
_FIRST = "(select call_id, field, first(case when disposition <> 'human_review' then value end) v from cells group by 1, 2)"
_FIELDS = ["reason", "product_line", "outcome", "objection", "competitor", "commitment_date", "dollar_amount", "sentiment", "disclosure_given", "escalation_requested", "issue_note", "callback_window"]

QUERIES = {
    "cells_resolved": q_cells_resolved,
    "tercile_cuts": q_tercile_cuts,
    "analysis_rows": q_analysis_rows,
    "value_domains": q_value_domains,
    "rare_values_dropped": q_rare_values_dropped,
    "observation_counts": q_observation_counts,
    "cells_pivot": q_cells_pivot,
    "cells_unpivot": q_cells_unpivot,
    "corpus_stats": q_corpus_stats,
    "disposition_histogram": q_disposition_histogram,
}
SQL = {
    "cells_resolved": f"with {ROWS_CTE} select call_id, field, value from resolved",
    "tercile_cuts": f"with {ROWS_CTE} select field, n, lo, hi from cuts",
    "analysis_rows": f"with {ROWS_CTE} select call_id, field, value from rows",
    "value_domains": f"with {ROWS_CTE} select * from vc where n >= 6",
    "rare_values_dropped": f"with {ROWS_CTE} select field, count(*) dropped from vc where n < 6 group by 1",
    "observation_counts": f"with {ROWS_CTE} select field, count(*) n from rows group by 1",
    "cells_pivot": f"with {CELLS_CTE} select call_id, " + ", ".join(f"max(case when field = '{f}' and disposition <> 'human_review' then value end) {f}" for f in _FIELDS) + " from cells group by 1",
    "cells_unpivot": "select distinct * from (" + " union all ".join(f"select call_id, '{f}' field, {FOLD.format(f)} as value from gold where call_id is not null" for f in ("reason", "product_line", "outcome", "objection", "competitor", "sentiment")) + ") where value <> ''",
    "corpus_stats": f"with {CALLS_CTE} select stratum, count(*) calls, round(avg(len(turns)), 6) avg_turns, round(avg(asr_confidence), 6) avg_confidence from calls group by 1",
    "disposition_histogram": f"with {CELLS_CTE}, n as (select disposition, count(*) n from cells group by 1) select *, round(n / sum(n) over (), 6) share from n",
}
