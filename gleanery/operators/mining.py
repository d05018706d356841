"""Hypotheses over the analysis rows: associations, concentrations and trends, tested, adjusted, checked and ranked.

One shuffle by call pairs the cells of each call in place (a call has one cell per field, so its pairs are bounded by the
fields); counts per (stratum, condition, outcome) of these pairs, combined before they are shuffled, give everything else:
n, k, strata for the standardised lift, and the modal agreement of columns. Pairs that never occur have k = 0 and
can't pass the gate; they count among the tests, whose number is added up from pools and domains without being enumerated.

Order within ties: hypotheses of one p-value are ranked by family, condition and outcome. p-values are compared at 12 decimals.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.common import durable, stored
from gleanery.functions.statistics import binomial_tail

from . import cells as C

#: The documented thresholds.
MIN_K, MIN_LIFT, FDR_Q, MIN_POOL, TAXONOMY, REDUNDANT, MIN_JOINT, MIN_DATED, MAX_SIGNALS = 6, 1.4, 0.05, 6, 0.97, 0.97, 24, 24, 8
KEY = ["family", "cond_field", "cond_value", "out_field", "out_value"]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(stratum, cf, cv, of, ov, k) over the ordered pairs of different fields of each call, all values included."""
    per_call = rows.groupBy("call_id").agg(F.first("stratum").alias("stratum"), F.collect_list(F.struct("field", "value")).alias("c"))
    pairs = F.expr("flatten(transform(c, a -> transform(filter(c, b -> b.field <> a.field), b -> struct(a.field as cf, a.value as cv, b.field as of, b.value as ov))))")
    return per_call.select("stratum", F.explode(pairs).alias("p")).groupBy("stratum", "p.cf", "p.cv", "p.of", "p.ov").agg(F.count(F.lit(1)).alias("k"))


def domain(rows: DataFrame) -> DataFrame:
    """(field, value, total, observed, values): values of at least 6 calls, with the calls that resolved the field and the size of its domain."""
    vc = C.value_counts(rows)
    observed = vc.groupBy("field").agg(F.sum("n").alias("observed"), F.count_if(F.col("n") >= C.MIN_VALUE).alias("values"))
    return vc.where(F.col("n") >= C.MIN_VALUE).withColumnRenamed("n", "total").join(observed, "field")


def _hypotheses(x: DataFrame) -> DataFrame:
    """Rates, lift, tail and exclusivity of counts n, k with a baseline and the outcome's total."""
    x = x.withColumn("conditional_rate", F.col("k") / F.col("n")).withColumn("lift", F.col("conditional_rate") / F.col("baseline_rate"))
    x = x.withColumn("p_value", binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), "baseline_rate")).withColumn("exclusivity", F.col("k") / F.col("total"))
    return x.select(*KEY, "n", "k", "conditional_rate", "baseline_rate", "lift", "p_value", "exclusivity")


def associations(pairs: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observed hypotheses of the association family, and (tests): how many were tested with those of k = 0."""
    k = pairs.groupBy("cf", "cv", "of", "ov").agg(F.sum("k").alias("k"))
    k = k.join(dom.select(F.col("field").alias("cf"), F.col("value").alias("cv")), ["cf", "cv"], "left_semi")
    # every call of a pool has one outcome, so the pool is the sum over its outcomes
    pools = k.groupBy("cf", "cv", "of").agg(F.sum("k").alias("n")).where(F.col("n") >= MIN_POOL)
    sizes = dom.select(F.col("field").alias("of"), "values").distinct()
    tests = pools.join(sizes, "of").agg(F.coalesce(F.sum("values"), F.lit(0)).alias("tests"))
    outcomes = dom.select(F.col("field").alias("of"), F.col("value").alias("ov"), "total", (F.col("total") / F.col("observed")).alias("baseline_rate"))
    x = k.join(pools, ["cf", "cv", "of"]).join(outcomes, ["of", "ov"])
    x = x.select(F.lit("association").alias("family"), F.col("cf").alias("cond_field"), F.col("cv").alias("cond_value"), F.col("of").alias("out_field"), F.col("ov").alias("out_value"), "n", "k", "baseline_rate", "total")
    return _hypotheses(x), tests


def concentrations(rows: DataFrame, dom: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with the stratum as the condition."""
    k = rows.where("stratum is not null").groupBy("stratum", "field", "value").agg(F.count(F.lit(1)).alias("k"))
    pools = k.groupBy("stratum", "field").agg(F.sum("k").alias("n")).where(F.col("n") >= MIN_POOL)
    tests = pools.join(dom.select("field", "values").distinct(), "field").agg(F.coalesce(F.sum("values"), F.lit(0)).alias("tests"))
    x = k.join(pools, ["stratum", "field"]).join(dom.withColumn("baseline_rate", F.col("total") / F.col("observed")), ["field", "value"])
    x = x.select(F.lit("stratum").alias("family"), F.lit("stratum").alias("cond_field"), F.col("stratum").alias("cond_value"), F.col("field").alias("out_field"), F.col("value").alias("out_value"), "n", "k", "baseline_rate", "total")
    return _hypotheses(x), tests


def halves(calls_: DataFrame) -> DataFrame:
    """(call_id, late): dated calls split at their median by date and position; calls without any cell count as well.

    Only the calls of the one date on which the median falls are ranked; the days are counted, of which there are few.
    """
    dated = calls_.where("captured_at is not null").select("call_id", "captured_at", "pos")
    days = dated.groupBy("captured_at").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    days = days.withColumn("upto", F.sum("n").over(w.orderBy("captured_at"))).withColumn("early", F.floor(F.sum("n").over(w) / 2)).withColumn("dated", F.sum("n").over(w))
    # of this date so many are early
    days = days.select("captured_at", "dated", F.least(F.col("n"), F.greatest(F.lit(0), F.col("early") - (F.col("upto") - F.col("n")))).alias("first"), "n")
    x = dated.join(days, "captured_at").where(F.col("dated") >= MIN_DATED)
    split = (F.col("first") > 0) & (F.col("first") < F.col("n"))
    whole = x.where(~split).select("call_id", (F.col("first") == 0).alias("late"))
    ranked = x.where(split).select("call_id", (F.row_number().over(Window.partitionBy("captured_at").orderBy("pos", "call_id")) > F.col("first")).alias("late"))
    return whole.unionByName(ranked)


def trends(rows: DataFrame, dom: DataFrame, half: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The late half against the early half; a value that the early half lacks is no hypothesis and no test."""
    k = rows.join(half, "call_id").groupBy("field", "value").agg(F.count_if("late").alias("k"), F.count_if(~F.col("late")).alias("early"))
    pools = k.groupBy("field").agg(F.sum("k").alias("n"), F.sum("early").alias("n_early")).where((F.col("n") >= MIN_POOL) & (F.col("n_early") >= MIN_POOL))
    x = k.join(pools, "field").join(dom.select("field", "value"), ["field", "value"], "left_semi").where("early > 0")
    x = x.withColumn("baseline_rate", F.col("early") / F.col("n_early")).withColumn("total", F.col("k") + F.col("early"))
    tests = x.agg(F.count(F.lit(1)).alias("tests"))
    x = x.where("k > 0").select(F.lit("trend").alias("family"), F.lit("period").alias("cond_field"), F.lit("late").alias("cond_value"), F.col("field").alias("out_field"), F.col("value").alias("out_value"), "n", "k", "baseline_rate", "total")
    return _hypotheses(x), tests


def adjusted(hyps: DataFrame, tests: int) -> DataFrame:
    """Benjamini-Hochberg over the gate's survivors with all tests counted: those up to the cutoff, with rank and q.

    The gate leaves few; they are ranked in one window.
    """
    gated = hyps.where((F.col("k") >= MIN_K) & (F.col("lift") >= MIN_LIFT))
    order = [F.round("p_value", 12), F.expr("case family when 'association' then 0 when 'stratum' then 1 else 2 end"), "cond_field", "cond_value", "out_field", "out_value"]
    ranked = gated.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    cutoff = F.max(F.when(F.round("p_value", 12) <= F.col("rank") / F.lit(max(tests, 1)) * FDR_Q, F.col("rank"))).over(Window.partitionBy())
    return ranked.withColumn("cutoff", cutoff).where("rank <= cutoff").withColumn("q_value", F.least(F.lit(1.0), F.col("p_value") * tests / F.col("rank"))).drop("cutoff")


def deduped(x: DataFrame) -> DataFrame:
    """Of an association and its mirror the one of higher lift (then of lower rank), at the better place of the two."""
    a, b = (F.struct(F.col(f"{x}_field").alias("f"), F.col(f"{x}_value").alias("v")) for x in ("cond", "out"))
    mirror = F.when(F.col("family") == "association", F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))).otherwise(F.struct(a.alias("x"), b.alias("y")))
    w = Window.partitionBy("family", "mirror")
    x = x.withColumn("mirror", mirror).withColumn("place", F.min("rank").over(w)).withColumn("best", F.row_number().over(w.orderBy(F.round("lift", 9).desc(), "rank")))
    return x.where("best = 1").drop("mirror", "best")


def stratified_lift(pairs: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """(condition, outcome, stratified_lift): observed over expected calls, expected by the outcome's rate within each stratum."""
    want = found.where("family = 'association'").select(*(F.col(c).alias(d) for c, d in (("cond_field", "cf"), ("cond_value", "cv"), ("out_field", "of"), ("out_value", "ov")))).distinct()
    pools = pairs.join(want.select("cf", "cv", "of").distinct(), ["cf", "cv", "of"], "left_semi").groupBy("stratum", "cf", "cv", "of").agg(F.sum("k").alias("n"))
    by = rows.groupBy("stratum", "field", "value").agg(F.count(F.lit(1)).alias("c"))
    rates = by.withColumn("rate", F.col("c") / F.sum("c").over(Window.partitionBy("stratum", "field"))).select("stratum", F.col("field").alias("of"), F.col("value").alias("ov"), "rate")
    x = pools.join(want, ["cf", "cv", "of"])
    x = x.alias("x").join(rates.alias("r"), F.expr("x.stratum <=> r.stratum and x.of = r.of and x.ov = r.ov"), "left").select("x.*", F.coalesce("r.rate", F.lit(0.0)).alias("rate"))
    x = x.alias("x").join(pairs.alias("p"), F.expr("x.stratum <=> p.stratum and x.cf = p.cf and x.cv = p.cv and x.of = p.of and x.ov = p.ov"), "left").select("x.*", F.coalesce("p.k", F.lit(0)).alias("k"))
    return x.groupBy(F.col("cf").alias("cond_field"), F.col("cv").alias("cond_value"), F.col("of").alias("out_field"), F.col("ov").alias("out_value")).agg((F.sum("k") / F.nullif(F.sum(F.col("n") * F.col("rate")), F.lit(0.0))).alias("stratified_lift"))


def redundant_columns(pairs: DataFrame) -> DataFrame:
    """(a, b, joint, agreement), a < b: how well each column's modal value given the other's predicts it, the worse way round."""
    k = pairs.groupBy("cf", "cv", "of", "ov").agg(F.sum("k").alias("k"))
    modal = k.groupBy("cf", "cv", "of").agg(F.max("k").alias("top"), F.sum("k").alias("n")).groupBy("cf", "of").agg((F.sum("top") / F.sum("n")).alias("agreement"), F.sum("n").alias("joint"))
    both = modal.groupBy(F.least("cf", "of").alias("a"), F.greatest("cf", "of").alias("b")).agg(F.min("agreement").alias("agreement"), F.first("joint").alias("joint"))
    return both.where(F.col("joint") >= MIN_JOINT)


def findings(rows: DataFrame, calls_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The adjusted, checked and ranked hypotheses, and the table of tests per family."""
    rows = stored(rows)
    pairs, dom = durable(pair_counts(rows)), durable(domain(rows))
    families = (associations(pairs, dom), concentrations(rows, dom), trends(rows, dom, halves(calls_)))
    hyps = families[0][0].unionByName(families[1][0]).unionByName(families[2][0])
    tests = families[0][1].unionByName(families[1][1]).unionByName(families[2][1])
    m = tests.agg(F.sum("tests")).first()[0]
    x = durable(deduped(adjusted(hyps, m)))
    x = x.join(stratified_lift(pairs, rows, x), KEY[1:], "left")
    x = x.withColumn("stratified_lift", F.when(F.col("family") == "association", F.col("stratified_lift")))
    # few columns have a redundant partner
    same = redundant_columns(pairs).where(F.col("agreement") >= REDUNDANT).select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.lit(True).alias("redundant"))
    both = same.unionByName(same.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), "redundant"))
    x = x.join(both, (F.col("cond_field") == F.col("_a")) & (F.col("out_field") == F.col("_b")), "left").drop("_a", "_b")
    verdict = F.when(F.col("redundant"), "redundant").when(F.col("exclusivity") >= TAXONOMY, "taxonomy").when(F.col("stratified_lift") < MIN_LIFT, "confounded").otherwise("finding")
    return x.withColumn("verdict", verdict).drop("redundant"), tests


def ranked(x: DataFrame) -> DataFrame:
    order = ["verdict = 'finding' desc", "round(q_value, 12)", "round(lift, 9) desc", "place"]
    return x.withColumn("position", F.row_number().over(Window.orderBy(*(F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.expr(o) for o in order))))


def supporting(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(condition, outcome, call_id): the calls behind each association, one row each, so that no hypothesis is one long row."""
    a = rows.select("call_id", F.col("field").alias("cond_field"), F.col("value").alias("cond_value"))
    b = rows.select("call_id", F.col("field").alias("out_field"), F.col("value").alias("out_value"))
    want = found.where("family = 'association'").select(*KEY[1:])
    return a.join(want, ["cond_field", "cond_value"]).join(b, ["call_id", "out_field", "out_value"]).select(*KEY[1:], "call_id")


def _round(x: DataFrame, columns=("conditional_rate", "baseline_rate", "lift", "p_value", "exclusivity", "q_value", "stratified_lift", "agreement")) -> DataFrame:
    return x.select(*(F.round(c, 6).alias(c) if c in columns else c for c in x.columns))


def q_associations(spark, sf_dir):
    rows = C.analysis_rows(spark, sf_dir)
    return _round(associations(durable(pair_counts(rows)), domain(rows))[0])


def q_stratum_concentration(spark, sf_dir):
    rows = C.analysis_rows(spark, sf_dir)
    return _round(concentrations(rows, domain(rows))[0])


def q_trend_halves(spark, sf_dir):
    rows = C.analysis_rows(spark, sf_dir)
    return _round(trends(rows, domain(rows), halves(C.calls(spark, sf_dir)))[0])


def _found(spark, sf_dir):
    return findings(C.analysis_rows(spark, sf_dir), C.calls(spark, sf_dir))


def q_tests(spark, sf_dir):
    return _found(spark, sf_dir)[1].agg(F.sum("tests").alias("tests"))


def q_bh_adjust(spark, sf_dir):
    rows = C.analysis_rows(spark, sf_dir)
    pairs, dom = durable(pair_counts(rows)), durable(domain(rows))
    f = (associations(pairs, dom), concentrations(rows, dom), trends(rows, dom, halves(C.calls(spark, sf_dir))))
    m = f[0][1].unionByName(f[1][1]).unionByName(f[2][1]).agg(F.sum("tests")).first()[0]
    return _round(adjusted(f[0][0].unionByName(f[1][0]).unionByName(f[2][0]), m).select(*KEY, "n", "k", "p_value", "rank", "q_value"))


def q_classify(spark, sf_dir):
    return _round(_found(spark, sf_dir)[0].select(*KEY, "n", "k", "lift", "q_value", "stratified_lift", "exclusivity", "verdict"))


def q_top_findings(spark, sf_dir):
    return _round(ranked(_found(spark, sf_dir)[0]).where((F.col("verdict") == "finding") & (F.col("position") <= MAX_SIGNALS)).select("position", *KEY, "k", "lift", "q_value"))


def q_redundant_columns(spark, sf_dir):
    return _round(redundant_columns(pair_counts(C.analysis_rows(spark, sf_dir))))


def q_supporting_calls(spark, sf_dir):
    return supporting(C.analysis_rows(spark, sf_dir), _found(spark, sf_dir)[0])


_DOM = "dom as (select v.*, o.observed from vc v join (select field, sum(n) observed from vc group by 1) o on o.field = v.field where v.n >= 6)"
_TAIL = "case when k <= 0 then 1.0 when b >= 1 then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(b) + (n - i) * ln(1 - b))) from (select unnest(generate_series(k::bigint, n::bigint)) i)) end"
_FAMILIES = f"""{_DOM}, pool as (
  select a.field cf, a.value cv, o.field of, count(*) n from rows a join rows o on o.call_id = a.call_id and o.field <> a.field
  join dom d on d.field = a.field and d.value = a.value group by 1, 2, 3 having count(*) >= 6
), hit as (
  select a.field cf, a.value cv, o.field of, o.value ov, count(*) k from rows a join rows o on o.call_id = a.call_id and o.field <> a.field group by 1, 2, 3, 4
), assoc as (
  select 'association' family, p.cf cond_field, p.cv cond_value, p.of out_field, d.value out_value, p.n, coalesce(h.k, 0) k, d.n / d.observed b, d.n total
  from pool p join dom d on d.field = p.of left join hit h on h.cf = p.cf and h.cv = p.cv and h.of = p.of and h.ov = d.value
), spool as (select stratum, field, count(*) n from rows where stratum is not null group by 1, 2 having count(*) >= 6
), shit as (select stratum, field, value, count(*) k from rows group by 1, 2, 3
), strat as (
  select 'stratum' family, 'stratum' cond_field, p.stratum cond_value, p.field out_field, d.value out_value, p.n, coalesce(h.k, 0) k, d.n / d.observed b, d.n total
  from spool p join dom d on d.field = p.field left join shit h on h.stratum = p.stratum and h.field = p.field and h.value = d.value
), half as (
  select call_id, row_number() over (order by captured_at, pos, call_id) > count(*) over () // 2 late from calls where captured_at is not null qualify count(*) over () >= 24
), t as (select field, value, late from rows r join half h on h.call_id = r.call_id
), tp as (select field, count(*) filter (late) n, count(*) filter (not late) e from t group by 1 having count(*) filter (late) >= 6 and count(*) filter (not late) >= 6
), th as (select field, value, count(*) filter (late) k, count(*) filter (not late) e from t group by 1, 2
), trend as (
  select 'trend' family, 'period' cond_field, 'late' cond_value, p.field out_field, d.value out_value, p.n, h.k, h.e / p.e b, h.k + h.e total
  from tp p join dom d on d.field = p.field join th h on h.field = p.field and h.value = d.value where h.e > 0
), every as (select * from assoc union all select * from strat union all select * from trend
), tested as (select *, k / n conditional_rate, k / n / b lift, k / total exclusivity from every where k > 0
), gated as (select *, {_TAIL} p_value from tested where k >= 6 and lift >= 1.4
), m as (select count(*) m from every
), bh as (
  select *, row_number() over (order by round(p_value, 12), case family when 'association' then 0 when 'stratum' then 1 else 2 end, cond_field, cond_value, out_field, out_value) rank from gated
), kept as (
  select *, least(1.0, p_value * m / rank) q_value from (select *, max(case when round(p_value, 12) <= rank / m * 0.05 then rank end) over () cutoff from bh, m) where rank <= cutoff
)"""
_CHECKED = f"""{_FAMILIES}, mirrored as (
  select *, case when family = 'association' then least(cond_field || chr(1) || cond_value, out_field || chr(1) || out_value) || chr(2) || greatest(cond_field || chr(1) || cond_value, out_field || chr(1) || out_value)
    else cond_field || chr(1) || cond_value || chr(2) || out_field || chr(1) || out_value end mirror from kept
), one as (select *, min(rank) over (partition by family, mirror) place from mirrored qualify row_number() over (partition by family, mirror order by round(lift, 9) desc, rank) = 1
), rate as (select stratum, field, value, count(*) / sum(count(*)) over (partition by stratum, field) rate from rows group by 1, 2, 3
), spairs as (select a.stratum, a.field cf, a.value cv, o.field of, o.value ov, count(*) k from rows a join rows o on o.call_id = a.call_id and o.field <> a.field group by 1, 2, 3, 4, 5
), sn as (select stratum, cf, cv, of, sum(k) n from spairs group by 1, 2, 3, 4
), std as (
  select o.cond_field, o.cond_value, o.out_field, o.out_value, sum(coalesce(p.k, 0)) / nullif(sum(n.n * coalesce(r.rate, 0)), 0) stratified_lift
  from one o join sn n on n.cf = o.cond_field and n.cv = o.cond_value and n.of = o.out_field
  left join rate r on r.stratum = n.stratum and r.field = o.out_field and r.value = o.out_value
  left join spairs p on p.stratum = n.stratum and p.cf = n.cf and p.cv = n.cv and p.of = n.of and p.ov = o.out_value
  where o.family = 'association' group by 1, 2, 3, 4
), modal as (select cf, of, sum(top) / sum(n) agreement, sum(n) joint from (select cf, cv, of, max(k) top, sum(k) n from hit group by 1, 2, 3) group by 1, 2
), red as (select least(cf, of) a, greatest(cf, of) b, min(agreement) agreement, any_value(joint) joint from modal group by 1, 2 having any_value(joint) >= 24
), checked as (
  select o.*, s.stratified_lift, case when r.a is not null then 'redundant' when o.exclusivity >= 0.97 then 'taxonomy' when s.stratified_lift < 1.4 then 'confounded' else 'finding' end verdict
  from one o left join std s on o.family = 'association' and s.cond_field = o.cond_field and s.cond_value = o.cond_value and s.out_field = o.out_field and s.out_value = o.out_value
  left join red r on r.agreement >= 0.97 and r.a = least(o.cond_field, o.out_field) and r.b = greatest(o.cond_field, o.out_field)
)"""
_K = ", ".join(KEY)
_FULL = f"select {_K}, n, k, round(conditional_rate, 6) conditional_rate, round(b, 6) baseline_rate, round(lift, 6) lift, round({_TAIL}, 6) p_value, round(exclusivity, 6) exclusivity from tested"
QUERIES = {
    "associations": q_associations,
    "stratum_concentration": q_stratum_concentration,
    "trend_halves": q_trend_halves,
    "hypotheses_tested": q_tests,
    "bh_adjust": q_bh_adjust,
    "classify_hypotheses": q_classify,
    "top_findings": q_top_findings,
    "redundant_columns": q_redundant_columns,
    "supporting_calls": q_supporting_calls,
}
_W = f"with {C.ROWS_CTE}, "
SQL = {
    "associations": f"{_W}{_FAMILIES} {_FULL} where family = 'association'",
    "stratum_concentration": f"{_W}{_FAMILIES} {_FULL} where family = 'stratum'",
    "trend_halves": f"{_W}{_FAMILIES} {_FULL} where family = 'trend'",
    "hypotheses_tested": f"{_W}{_FAMILIES} select m tests from m",
    "bh_adjust": f"{_W}{_FAMILIES} select {_K}, n, k, round(p_value, 6) p_value, rank, round(q_value, 6) q_value from kept",
    "classify_hypotheses": f"{_W}{_CHECKED} select {_K}, n, k, round(lift, 6) lift, round(q_value, 6) q_value, round(stratified_lift, 6) stratified_lift, round(exclusivity, 6) exclusivity, verdict from checked",
    "top_findings": f"{_W}{_CHECKED} select position, {_K}, k, round(lift, 6) lift, round(q_value, 6) q_value from (select *, row_number() over (order by verdict = 'finding' desc, round(q_value, 12), round(lift, 9) desc, place) position from checked) where verdict = 'finding' and position <= 8",
    "redundant_columns": f"{_W}{_CHECKED} select a, b, round(agreement, 6) agreement, joint::bigint joint from red",
    "supporting_calls": f"{_W}{_CHECKED} select {', '.join('o.' + k for k in KEY[1:])}, a.call_id from checked o join rows a on a.field = o.cond_field and a.value = o.cond_value join rows b on b.call_id = a.call_id and b.field = o.out_field and b.value = o.out_value where o.family = 'association'",
}
