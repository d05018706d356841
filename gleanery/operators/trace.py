"""Spans of agents: rollups, nearest-rank percentiles and costs.

A span delivered twice counts once (the first received); agents are folded; null or negative durations count for no percentile and
add nothing to the total. Prices are a table the caller gives, per million tokens.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.common import folded, table
from gleanery.functions.ranks import nearest_rank

PRICES = [("sim-large", 5.0, 25.0), ("sim-small", 1.0, 5.0)]
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def exact_sum(c: str, digits: int = 6):
    """Sums of money as decimals, so the order of rows doesn't matter."""
    return F.sum(F.col(c).cast(f"decimal(18,{digits})")).cast("double")


def spans(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "spans").where("id is not null").withColumn("agent", folded("agent"))
    rest = [c for c in s.columns if c != "id"]
    return s.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("received_at", "started_at", "duration_ms")).alias("s")).select("id", "s.*")


def rollup(s: DataFrame, keys: list[str]) -> DataFrame:
    good = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    sums = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        *(F.sum(c).alias(c) for c in ("retries", "input_tokens", "output_tokens", "cache_read_tokens")),
        exact_sum("cost_usd").alias("cost_usd"),
        F.sum(good).alias("total_ms"),
    )
    p = nearest_rank(s.where("duration_ms >= 0"), keys, "duration_ms", {"p50_ms": (50, 100), "p95_ms": (95, 100)}).drop("n")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return sums.alias("a").join(p.alias("b"), same, "left").select("a.*", F.coalesce("b.p50_ms", F.lit(0)).alias("p50_ms"), F.coalesce("b.p95_ms", F.lit(0)).alias("p95_ms"))


def token_cost(s: DataFrame, prices: DataFrame) -> DataFrame:
    """cost of each span: cache reads at a tenth, cache writes at five fourths of the input price; a model without a price costs as the dearest."""
    dearest = prices.agg(F.max(F.struct("input_price", "output_price")).alias("d")).select("d.*").toDF("d_in", "d_out")
    x = s.join(F.broadcast(prices), "model", "left").join(F.broadcast(dearest))
    i, o = F.coalesce("input_price", "d_in"), F.coalesce("output_price", "d_out")
    n = lambda c: F.coalesce(c, F.lit(0))
    return x.withColumn("cost", ((n("input_tokens") + n("cache_read_tokens") * CACHE_READ + n("cache_creation_tokens") * CACHE_WRITE) * i + n("output_tokens") * o) / 1_000_000).drop("d_in", "d_out", "input_price", "output_price")


def q_agent_rollup(spark, sf_dir):
    return rollup(spans(spark, sf_dir), ["run_id", "agent"])


def q_agent_totals(spark, sf_dir):
    x = rollup(spans(spark, sf_dir), ["agent"])
    return x.withColumn("cost_share", F.round(F.col("cost_usd") / F.sum("cost_usd").over(Window.partitionBy()), 6))


def q_percentiles(spark, sf_dir):
    return nearest_rank(spans(spark, sf_dir).where("duration_ms >= 0"), ["agent"], "duration_ms", {"p10": (10, 100), "p50": (50, 100), "p95": (95, 100), "p99": (99, 100)})


def q_token_cost(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "model string, input_price double, output_price double")
    return token_cost(spans(spark, sf_dir), prices).groupBy("run_id", "model").agg(exact_sum("cost", 9).alias("cost"))


def q_cost_by_prefix(spark, sf_dir):
    return spans(spark, sf_dir).groupBy(F.element_at(F.split("agent", r"\."), 1).alias("stage")).agg(exact_sum("cost_usd").alias("cost_usd"), F.count_if(~F.col("ok")).alias("failures"))


def q_span_sequence(spark, sf_dir):
    """Spans numbered within their call, by start; a call has few spans."""
    s = spans(spark, sf_dir).where("call_id is not null")
    return s.select("id", "call_id", F.row_number().over(Window.partitionBy("call_id").orderBy("started_at", "id")).alias("seq"))


_S = r"""s as (select id, x.run_id, lower(regexp_replace(x.agent, '^\s+|\s+$', '', 'g')) agent, x.model, x.call_id, x.started_at, x.d duration_ms, x.i input_tokens, x.o output_tokens, x.cr cache_read_tokens, x.cc cache_creation_tokens, x.cost cost_usd, x.retries, x.ok from (
  select id, arg_min({'run_id': run_id, 'agent': agent, 'model': model, 'call_id': call_id, 'started_at': started_at, 'd': duration_ms, 'i': input_tokens, 'o': output_tokens, 'cr': cache_read_tokens, 'cc': cache_creation_tokens, 'cost': cost_usd, 'retries': retries, 'ok': ok}, (received_at, started_at, duration_ms)) x from spans where id is not null group by 1)
), o as (select *, row_number() over (partition by run_id, agent order by duration_ms) - 1 place, count(*) over (partition by run_id, agent) n, row_number() over (partition by agent order by duration_ms) - 1 place_a, count(*) over (partition by agent) n_a from s where duration_ms >= 0)"""
_SUMS = "count(*) calls, count(*) filter (not ok) failures, sum(retries)::bigint retries, sum(input_tokens)::bigint input_tokens, sum(output_tokens)::bigint output_tokens, sum(cache_read_tokens)::bigint cache_read_tokens, sum(cost_usd::decimal(18,6))::double cost_usd, (sum(duration_ms) filter (duration_ms >= 0))::bigint total_ms"


def _at(q, a=""):
    return f"max(duration_ms) filter (place{a} = least(n{a} - 1, n{a} * {q} // 100))"


QUERIES = {"agent_rollup": q_agent_rollup, "agent_totals": q_agent_totals, "nearest_rank_percentiles": q_percentiles, "token_cost": q_token_cost, "cost_by_stage": q_cost_by_prefix, "span_sequence": q_span_sequence}
SQL = {
    "agent_rollup": f"with {_S}, p as (select run_id, agent, {_at(50)} p50_ms, {_at(95)} p95_ms from o group by 1, 2), a as (select run_id, agent, {_SUMS} from s group by 1, 2) select a.*, coalesce(p50_ms, 0) p50_ms, coalesce(p95_ms, 0) p95_ms from a left join p on p.run_id is not distinct from a.run_id and p.agent is not distinct from a.agent",
    "agent_totals": f"with {_S}, p as (select agent, {_at(50, '_a')} p50_ms, {_at(95, '_a')} p95_ms from o group by 1), a as (select agent, {_SUMS} from s group by 1) select a.*, coalesce(p50_ms, 0) p50_ms, coalesce(p95_ms, 0) p95_ms, round(cost_usd / sum(cost_usd) over (), 6) cost_share from a left join p on p.agent is not distinct from a.agent",
    "nearest_rank_percentiles": f"with {_S} select agent, any_value(n_a) n, {_at(10, '_a')} p10, {_at(50, '_a')} p50, {_at(95, '_a')} p95, {_at(99, '_a')} p99 from o group by 1",
    "token_cost": f"with {_S} select run_id, model, sum((((coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0) * 0.1::double + coalesce(cache_creation_tokens, 0) * 1.25::double) * case when model = 'sim-small' then 1 else 5 end + coalesce(output_tokens, 0) * case when model = 'sim-small' then 5 else 25 end) / 1000000)::decimal(18,9))::double cost from s group by 1, 2",
    "cost_by_stage": f"with {_S} select split_part(agent, '.', 1) stage, sum(cost_usd::decimal(18,6))::double cost_usd, count(*) filter (not ok) failures from s group by 1",
    "span_sequence": f"with {_S} select id, call_id, row_number() over (partition by call_id order by started_at, id) seq from s where call_id is not null",
}
