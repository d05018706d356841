"""The validation funnel: which cells string checks settle, which a second reading sees, and at what coverage per column.

A second reading is a table (call_id, field, rejects, repair_holds), so any critic can stand behind it; the queries take the readings that
validated_cells records. The budget is one aggregate over the cells of the first 60 calls, joined back on the field; a column never read has no
rate (null, not 0) and full coverage. Impossible confidences count as null, and a null one as low.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

from . import cells as C
from .grounding import GROUNDED_CTE, grounded_cells
from .texts import FNV

#: The documented thresholds.
FLOOR, SKIP_ABOVE, CALIBRATION_CALLS, MULTIPLIER, PRIOR_REJECTS, PRIOR_ACCEPTS, MIN_COVERAGE = 0.45, 0.85, 60, 3, 1, 4, 0.05


def recorded_readings(cells_: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<verdict:string,reason:string,decided_by:string>>")
    rejects = F.exists(F.coalesce("verdicts", none), lambda v: (v["decided_by"] == "critic") & (v["verdict"] == "reject"))
    return cells_.select("call_id", "field", F.coalesce(rejects, F.lit(False)).alias("rejects"), F.coalesce(F.col("disposition") == "repaired", F.lit(False)).alias("repair_holds"))


def eligible(g: DataFrame, calls_: DataFrame) -> DataFrame:
    """Grounded cells with confidence, whether their call is one of the first 60, and the stage before any sampling."""
    first = calls_.select("call_id", "pos").orderBy(F.col("pos").asc_nulls_last(), "call_id").limit(CALIBRATION_CALLS).select("call_id", F.lit(True).alias("calibration"))
    x = g.join(F.broadcast(first), "call_id", "left").withColumn("calibration", F.coalesce("calibration", F.lit(False)))
    x = x.withColumn("confidence", F.when(F.col("confidence").between(0, 1), F.col("confidence")))
    stage = F.when(F.col("fatal").isNotNull(), "fatal").when(F.col("absence_claim"), "absence").when(~F.col("suspicious") & (F.col("confidence") >= SKIP_ABOVE), "skip").when(F.col("suspicious"), "force").otherwise("open")
    return x.withColumn("stage", stage)


def budgets(x: DataFrame, readings: DataFrame | None) -> DataFrame:
    """Per column: calibration reads and rejects, the smoothed rate and the coverage it buys. Without readings x has their columns."""
    open_ = F.col("stage") == "open"
    b = (x if readings is None else x.join(readings, ["call_id", "field"], "left")).groupBy("field").agg(
        F.count_if(F.col("calibration") & open_).alias("calibration_calls"),
        F.count_if(F.col("calibration") & open_ & F.col("rejects")).alias("calibration_rejects"),
        F.count_if(F.col("stage").isin("open", "force")).alias("eligible"),
        F.count_if(F.col("stage") == "force").alias("forced_by_suspicion"),
    )
    read = F.col("calibration_calls") > 0
    rate = F.when(read, F.col("calibration_rejects") / F.col("calibration_calls"))
    smoothed = F.when(read, (F.col("calibration_rejects") + PRIOR_REJECTS) / (F.col("calibration_calls") + PRIOR_REJECTS + PRIOR_ACCEPTS))
    return b.withColumn("rejection_rate", rate).withColumn("smoothed_rate", smoothed).withColumn("coverage", F.coalesce(S.clamped(smoothed * MULTIPLIER, MIN_COVERAGE, 1.0), F.lit(1.0)))


def routed(x: DataFrame, budget: DataFrame, readings: DataFrame | None) -> DataFrame:
    """Every cell with its route, who decided, its disposition and its number of attempts. Without readings x has their columns."""
    x = x.join(F.broadcast(budget.select("field", "coverage")), "field")
    x = x if readings is None else x.join(readings, ["call_id", "field"], "left")
    d = S.draw(F.concat_ws(":", F.lit("critic-sample"), "call_id", "field"))
    route = F.when(F.col("stage") != "open", F.col("stage")).when(F.col("calibration") | (d < F.col("coverage")), "sample").otherwise("unsampled")
    x = x.withColumn("route", route)
    low = F.coalesce(F.col("confidence") < FLOOR, F.lit(True))
    read = F.col("route").isin("force", "sample")
    rejects, holds = F.coalesce("rejects", F.lit(False)), F.coalesce("repair_holds", F.lit(False))
    disposition = F.when(F.col("route") == "fatal", "human_review").when(F.col("route") == "skip", "accepted").when(read & rejects, F.when(holds, "repaired").otherwise("human_review")).when(low, "human_review").otherwise("accepted")
    decided = F.when(F.col("route") == "unsampled", "sampling").when(read & ~rejects, "critic").otherwise("deterministic")
    return x.withColumn("settled", disposition).withColumn("decided_by", decided).withColumn("tries", F.when(read & rejects, 2).otherwise(1))


def _parts(spark, sf_dir):
    x = eligible(grounded_cells(spark, sf_dir), C.calls(spark, sf_dir))
    readings = recorded_readings(C.cells(spark, sf_dir))
    return x, budgets(x, readings), readings


def q_critic_budget(spark, sf_dir):
    b = _parts(spark, sf_dir)[1]
    return b.select(*(F.round(c, 6).alias(c) if c in ("rejection_rate", "smoothed_rate", "coverage") else c for c in b.columns))


def q_route_fields(spark, sf_dir):
    return routed(*_parts(spark, sf_dir)).select("call_id", "field", "route", "settled", "decided_by", "tries")


def q_funnel_counts(spark, sf_dir):
    return routed(*_parts(spark, sf_dir)).groupBy("route", "settled", "decided_by").agg(F.count(F.lit(1)).alias("n"))


def q_unsampled_share(spark, sf_dir):
    x = routed(*_parts(spark, sf_dir)).groupBy("field").agg(F.count_if(F.col("route") == "unsampled").alias("unsampled"), F.count(F.lit(1)).alias("n"))
    return x.withColumn("share", F.round(F.col("unsampled") / F.col("n"), 6))


ROUTED_CTE = f"""{GROUNDED_CTE}, first as (select call_id from calls order by pos nulls last, call_id limit 60
), rd as (select call_id, field, coalesce(len(list_filter(verdicts, lambda v: v.decided_by = 'critic' and v.verdict = 'reject')) > 0, false) rejects, coalesce(disposition = 'repaired', false) holds from cells
), el as (
  select g.* replace (case when g.confidence between 0 and 1 then g.confidence end as confidence), g.call_id in (select call_id from first) calibration, r.rejects, r.holds,
    case when fatal is not null then 'fatal' when absence_claim then 'absence' when not suspicious and g.confidence between 0.85 and 1 then 'skip' when suspicious then 'force' else 'open' end stage
  from gr g join rd r on r.call_id = g.call_id and r.field = g.field
), b0 as (
  select field, count(*) filter (calibration and stage = 'open') calibration_calls, count(*) filter (calibration and stage = 'open' and rejects) calibration_rejects,
    count(*) filter (stage in ('open', 'force')) eligible, count(*) filter (stage = 'force') forced_by_suspicion from el group by 1
), b as (select *, calibration_rejects / nullif(calibration_calls, 0) rejection_rate, case when calibration_calls > 0 then (calibration_rejects + 1) / (calibration_calls + 5) end smoothed_rate,
    case when calibration_calls > 0 then greatest(0.05, least(1.0, (calibration_rejects + 1) / (calibration_calls + 5) * 3)) else 1.0 end coverage from b0
), ro as (
  select e.*, case when stage <> 'open' then stage when calibration or {FNV.format("'critic-sample:' || e.call_id || ':' || e.field")} / 4294967296 < coverage then 'sample' else 'unsampled' end route from el e join b on b.field = e.field
), routed as (
  select *, case when route = 'fatal' then 'human_review' when route = 'skip' then 'accepted' when route in ('force', 'sample') and rejects then case when holds then 'repaired' else 'human_review' end
      when coalesce(confidence < 0.45, true) then 'human_review' else 'accepted' end settled,
    case when route = 'unsampled' then 'sampling' when route in ('force', 'sample') and not rejects then 'critic' else 'deterministic' end decided_by, case when route in ('force', 'sample') and rejects then 2 else 1 end tries from ro
)"""
QUERIES = {"critic_budget": q_critic_budget, "route_fields": q_route_fields, "funnel_counts": q_funnel_counts, "unsampled_share": q_unsampled_share}
SQL = {
    "critic_budget": f"with {ROUTED_CTE} select field, calibration_calls, calibration_rejects, eligible, forced_by_suspicion, round(rejection_rate, 6) rejection_rate, round(smoothed_rate, 6) smoothed_rate, round(coverage, 6)::double coverage from b",
    "route_fields": f"with {ROUTED_CTE} select call_id, field, route, settled, decided_by, tries from routed",
    "funnel_counts": f"with {ROUTED_CTE} select route, settled, decided_by, count(*) n from routed group by 1, 2, 3",
    "unsampled_share": f"with {ROUTED_CTE} select field, count(*) filter (route = 'unsampled') unsampled, count(*) n, round(count(*) filter (route = 'unsampled') / count(*), 6) share from routed group by 1",
}
