"""Cells against gold: scores per field, calibration, the second reader's confusion, routing curve, policy audit, alignment.

Gold rows of a call are one (repeated rows vary in letter case; of differing ones the least value counts); blanks are null. A missing
cell is a null prediction. Values are compared folded, numbers with a tolerance of 0.005; null against null is right.
"""

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.common import folded, table
from gleanery.functions import scalars as S
from gleanery.functions.ranks import running_counts

from . import cells as C

GOLD = ["reason", "product_line", "outcome", "objection", "competitor", "commitment_date", "dollar_amount", "sentiment", "disclosure_given", "escalation_requested"]
NUMBERS = ["dollar_amount"]
SHARES = [0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]
BINS = 10


def gold_long(spark, sf_dir) -> DataFrame:
    g = table(spark, sf_dir, "gold").where("call_id is not null")
    wide = g.select("call_id", *(F.nullif(folded(F.col(c).cast("string")), F.lit("")).alias(c) for c in GOLD))
    return wide.groupBy("call_id").agg(*(F.min(c).alias(c) for c in GOLD)).unpivot(["call_id"], GOLD, "field", "gold")


def scored(spark, sf_dir) -> DataFrame:
    """(call_id, field, gold, predicted, confidence, disposition, verdicts, right)."""
    c = C.cells(spark, sf_dir).select("call_id", "field", F.nullif(folded("value"), F.lit("")).alias("predicted"), "confidence", "disposition", "verdicts")
    x = gold_long(spark, sf_dir).join(c, ["call_id", "field"], "left")
    same = F.when(F.col("field").isin(NUMBERS), S.same_number(F.col("gold"), F.col("predicted"))).otherwise(F.col("gold") == F.col("predicted"))
    return x.withColumn("right", F.coalesce(same, F.lit(False)) | (F.col("gold").isNull() & F.col("predicted").isNull()))


def field_scores(x: DataFrame) -> DataFrame:
    has, said = F.col("gold").isNotNull(), F.col("predicted").isNotNull()
    s = x.groupBy("field").agg(
        F.count_if(has).alias("support"),
        F.count_if(has & said & F.col("right")).alias("correct"),
        F.count_if(has & ~said).alias("missed"),
        F.count_if(has & said & ~F.col("right")).alias("wrong"),
        F.count_if(~has & said).alias("invented"),
    )
    z = F.lit(0)
    s = s.withColumn("precision", F.col("correct") / F.nullif(F.col("correct") + F.col("wrong") + F.col("invented"), z)).withColumn("recall", F.col("correct") / F.nullif("support", z))
    return s.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


def q_field_scores(spark, sf_dir):
    return _r(field_scores(scored(spark, sf_dir)), "precision", "recall", "f1")


def q_macro_micro(spark, sf_dir):
    x = scored(spark, sf_dir)
    s = field_scores(x).agg(F.avg("f1").alias("macro_f1"), (F.sum("correct") / F.sum("support")).alias("micro"))
    return _r(s.join(F.broadcast(x.agg(F.avg(F.col("right").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("cells")))), "macro_f1", "micro", "accuracy")


def bins(x: DataFrame) -> DataFrame:
    """Cells by confidence in ten bins; edges are compared on integers, so none falls between two bins."""
    c = x.where(F.col("confidence").between(0, 1)).withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("confidence") * BINS + 1e-9)).cast("int"))
    return c.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def q_calibration_bins(spark, sf_dir):
    return _r(bins(scored(spark, sf_dir)), "confidence", "accuracy")


def q_calibration_error(spark, sf_dir):
    b = bins(scored(spark, sf_dir))
    return b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n"), 6).alias("ece"))


def q_critic_confusion(spark, sf_dir):
    """The second reader rejects if any of its verdicts does."""
    x = scored(spark, sf_dir).withColumn("rejects", F.coalesce(F.exists("verdicts", lambda v: (v["decided_by"] == "critic") & (v["verdict"] == "reject")), F.lit(False)))
    n = x.agg(*(F.count_if(r & w).alias(name) for name, r, w in (("tp", F.col("rejects"), ~F.col("right")), ("fp", F.col("rejects"), F.col("right")), ("fn", ~F.col("rejects"), ~F.col("right")), ("tn", ~F.col("rejects"), F.col("right")))))
    return n.withColumn("precision", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6)).withColumn("recall", F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6))


def routing_curve(x: DataFrame, shares: list[float] = SHARES) -> DataFrame:
    """Per share: errors among the least confident cells, and the accuracy of the rest. Ranks come from range partitions, not from one sort."""
    r = running_counts(x.withColumn("confidence", F.coalesce("confidence", F.lit(-1.0))), [], ["confidence", "call_id", "field", "right"])
    s = F.broadcast(x.sparkSession.createDataFrame([(float(v),) for v in shares], "share double"))
    reviewed = F.col("upto") <= F.floor(F.col("share") * F.col("total") + 1e-9)
    e = r.join(s).groupBy("share").agg(F.count_if(reviewed).alias("reviewed"), F.count_if(reviewed & ~F.col("right")).alias("caught"), F.count_if(~F.col("right")).alias("errors"), F.count(F.lit(1)).alias("cells"))
    return e.withColumn("auto_accuracy", 1 - (F.col("errors") - F.col("caught")) / F.nullif(F.col("cells") - F.col("reviewed"), F.lit(0)))


def q_routing_curve(spark, sf_dir):
    return _r(routing_curve(scored(spark, sf_dir)), "auto_accuracy")


def q_policy_audit(spark, sf_dir):
    """Shipped cells by who decided last."""
    x = scored(spark, sf_dir).where("disposition is not null and disposition <> 'human_review'").withColumn("decided_by", F.coalesce(F.expr("try_element_at(verdicts, -1).decided_by"), F.lit("none")))
    n = x.groupBy("decided_by").agg(F.count(F.lit(1)).alias("shipped"), F.count_if(~F.col("right")).alias("errors"))
    return _r(n.withColumn("error_rate", F.col("errors") / F.col("shipped")).withColumn("share_of_errors", F.col("errors") / F.sum("errors").over(Window.partitionBy())), "error_rate", "share_of_errors")


def q_review_efficiency(spark, sf_dir):
    x = scored(spark, sf_dir).where("disposition is not null")
    n = x.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("disposition") == "human_review").alias("reviewed"), F.count_if(~F.col("right")).alias("errors"), F.count_if(~F.col("right") & (F.col("disposition") == "human_review")).alias("caught"))
    return n.select("cells", "reviewed", "errors", "caught", F.round(F.col("caught") / F.col("errors"), 6).alias("errors_caught_share"), F.round(F.col("reviewed") / F.col("cells"), 6).alias("review_share"))


def mutual_information(spark, sf_dir) -> DataFrame:
    """(field, gold_field, nmi): mutual information over the root of both entropies, null as a value; over the calls that have gold."""
    g = gold_long(spark, sf_dir).select("call_id", F.col("field").alias("gold_field"), F.coalesce("gold", F.lit("∅")).alias("g"))
    c = C.cells(spark, sf_dir).select("call_id", "field", F.coalesce(F.nullif(folded("value"), F.lit("")), F.lit("∅")).alias("v"))
    j = g.join(c, "call_id").groupBy("field", "gold_field", "v", "g").agg(F.count(F.lit(1)).alias("n"))
    pair = ["field", "gold_field"]
    total, of_v, of_g = (F.sum("n").over(Window.partitionBy(*pair, *extra)) for extra in ([], ["v"], ["g"]))
    j = j.withColumn("t", total).withColumn("nv", of_v).withColumn("ng", of_g)
    p = F.col("n") / F.col("t")
    x = j.groupBy(*pair).agg(F.sum(p * F.log(p * F.col("t") * F.col("t") / (F.col("nv") * F.col("ng")))).alias("mi"), (-F.sum(p * F.log(F.col("nv") / F.col("t")))).alias("hv"), (-F.sum(p * F.log(F.col("ng") / F.col("t")))).alias("hg"))
    return x.select(*pair, F.when((F.col("hv") > 1e-12) & (F.col("hg") > 1e-12), F.col("mi") / F.sqrt(F.col("hv") * F.col("hg"))).otherwise(0.0).alias("nmi"))


def q_nmi_alignment(spark, sf_dir):
    return mutual_information(spark, sf_dir).select("field", "gold_field", F.abs(F.round("nmi", 5)).alias("nmi"))


def q_field_alignment(spark, sf_dir):
    """Each discovered field with its gold field: the same name first, then the best mutual information above 0.2, one to one.

    The matrix has a row per pair of fields of the schemas; matching it is a few steps on the driver.
    """
    rows = sorted(((r["nmi"], r["field"], r["gold_field"]) for r in q_nmi_alignment(spark, sf_dir).collect()), key=lambda r: (r[1] != r[2], -r[0], r[1], r[2]))
    used, out = set(), []
    for nmi, f, g in rows:
        if ("f", f) not in used and ("g", g) not in used and (f == g or (nmi >= 0.2 and not math.isnan(nmi))):
            used |= {("f", f), ("g", g)}
            out.append((f, g, nmi, "name" if f == g else "information"))
    out += [(f, None, None, "unmapped") for f in sorted({r[1] for r in rows} - {o[0] for o in out})]
    return spark.createDataFrame(out, "field string, gold_field string, nmi double, by string")


_FOLD = C.FOLD
_GOLD = ", ".join(f"min(nullif({_FOLD.format(f'{c}::varchar')}, '')) {c}" for c in GOLD)
SCORED_CTE = f"""{C.CELLS_CTE}, gw as (select call_id, {_GOLD} from gold where call_id is not null group by 1
), gl as ({' union all '.join(f"select call_id, '{c}' field, {c} gold from gw" for c in GOLD)}
), sc0 as (select g.*, nullif({_FOLD.format('c.value')}, '') predicted, c.confidence, c.disposition, c.verdicts from gl g left join cells c on c.call_id = g.call_id and c.field = g.field
), sc as (select *, coalesce(case when field = 'dollar_amount' then abs(try_cast(replace(gold, ',', '') as double) - try_cast(replace(predicted, ',', '') as double)) < 0.005 else gold = predicted end, false) or (gold is null and predicted is null) as "right" from sc0
), fs as (
  select field, count(gold) support, count(*) filter (gold is not null and predicted is not null and "right") correct, count(*) filter (gold is not null and predicted is null) missed,
    count(*) filter (gold is not null and predicted is not null and not "right") wrong, count(*) filter (gold is null and predicted is not null) invented from sc group by 1
), fp as (select *, correct / nullif(correct + wrong + invented, 0) "precision", correct / nullif(support, 0) recall from fs
), ff as (select *, 2 * "precision" * recall / nullif("precision" + recall, 0) f1 from fp
), bn as (select least(9, floor(confidence * 10 + 1e-9))::int as bin, count(*) n, avg(confidence) confidence, avg("right"::int) accuracy from sc where confidence between 0 and 1 group by 1)"""
_MI = f"""{SCORED_CTE}, j as (select c.field, g.field gold_field, coalesce(nullif({_FOLD.format('c.value')}, ''), '∅') v, coalesce(gold, '∅') g, count(*) n from gl g join cells c on c.call_id = g.call_id group by 1, 2, 3, 4
), jj as (select *, sum(n) over (partition by field, gold_field) t, sum(n) over (partition by field, gold_field, v) nv, sum(n) over (partition by field, gold_field, g) ng from j
), mi as (select field, gold_field, sum(n / t * ln(n / t * t * t / (nv * ng))) mi, -sum(n / t * ln(nv / t)) hv, -sum(n / t * ln(ng / t)) hg from jj group by 1, 2)"""
QUERIES = {
    "field_scores": q_field_scores,
    "macro_micro": q_macro_micro,
    "calibration_bins": q_calibration_bins,
    "calibration_error": q_calibration_error,
    "critic_confusion": q_critic_confusion,
    "routing_curve": q_routing_curve,
    "policy_audit": q_policy_audit,
    "review_efficiency": q_review_efficiency,
    "nmi_alignment": q_nmi_alignment,
    "field_alignment": q_field_alignment,
}
SQL = {
    "field_scores": f'with {SCORED_CTE} select field, support, correct, missed, wrong, invented, round("precision", 6) "precision", round(recall, 6) recall, round(f1, 6) f1 from ff',
    "macro_micro": f'with {SCORED_CTE} select round(avg(f1), 6) macro_f1, round(sum(correct) / sum(support), 6) micro, (select round(avg("right"::int), 6) from sc) accuracy, (select count(*) from sc) cells from ff',
    "calibration_bins": f"with {SCORED_CTE} select bin, n, round(confidence, 6) confidence, round(accuracy, 6) accuracy from bn",
    "calibration_error": f"with {SCORED_CTE} select round(sum(n * abs(accuracy - confidence)) / sum(n), 6) ece from bn",
    "critic_confusion": f"""with {SCORED_CTE}, r as (select "right", coalesce(len(list_filter(verdicts, lambda v: v.decided_by = 'critic' and v.verdict = 'reject')) > 0, false) j from sc
), n as (select count(*) filter (j and not "right") tp, count(*) filter (j and "right") fp, count(*) filter (not j and not "right") fn, count(*) filter (not j and "right") tn from r) select *, round(tp / nullif(tp + fp, 0), 6) "precision", round(tp / nullif(tp + fn, 0), 6) recall from n""",
    "routing_curve": f"""with {SCORED_CTE}, r as (select "right", row_number() over (order by coalesce(confidence, -1), call_id, field) k, count(*) over () n from sc), e as (
  select share, count(*) filter (k <= floor(share * n + 1e-9)) reviewed, count(*) filter (k <= floor(share * n + 1e-9) and not "right") caught, count(*) filter (not "right") errors, count(*) cells from r, (select unnest([0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5])::double share) group by 1)
select *, round(1 - (errors - caught) / nullif(cells - reviewed, 0), 6) auto_accuracy from e""",
    "policy_audit": f"""with {SCORED_CTE}, n as (select coalesce(verdicts[-1].decided_by, 'none') decided_by, count(*) shipped, count(*) filter (not "right") errors from sc where disposition <> 'human_review' group by 1)
select *, round(errors / shipped, 6) error_rate, round(errors / sum(errors) over (), 6) share_of_errors from n""",
    "review_efficiency": f"""with {SCORED_CTE}, n as (select count(*) cells, count(*) filter (disposition = 'human_review') reviewed, count(*) filter (not "right") errors, count(*) filter (not "right" and disposition = 'human_review') caught from sc where disposition is not null)
select *, round(caught / errors, 6) errors_caught_share, round(reviewed / cells, 6) review_share from n""",
    "nmi_alignment": f"with {_MI} select field, gold_field, abs(round(case when hv > 1e-12 and hg > 1e-12 then mi / sqrt(hv * hg) else 0 end, 5)) nmi from mi",
}
