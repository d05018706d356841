"""Samples that any engine draws alike: by key hash, by strata with equal quotas, with a top-up; slices; bands.

Draws are by a hash of the key, so no order of rows or partitions matters. Top-k per stratum is taken per salt first, so a stratum
that holds most calls is never ranked in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import scalars as S

from . import cells as C
from .texts import FNV

SIZE, SLICES, RATE, SALTS = 24, 4, 0.1, 64
#: Bands of the recogniser's confidence, from the lower edge on; above all bands is clean, as is none.
BANDS = [("clean", 0.85, 1.01), ("mixed", 0.7, 0.85), ("degraded", 0.0, 0.7)]


def band(c: Column) -> Column:
    out = None
    for name, low, high in BANDS:
        inside = (c >= low) & (c < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("clean")


def strata(calls_: DataFrame) -> DataFrame:
    x = calls_.withColumn("key", F.concat_ws("/", F.coalesce("stratum", F.lit("")), band(F.col("asr_confidence"))))
    return x.select("call_id", "key", S.fnv1a(F.concat(F.lit("draw:"), "call_id")).alias("draw"))


def top_per_key(x: DataFrame, key: str, order: list, k: str) -> DataFrame:
    """Of each key the first k (a column) rows in order, first by salt and then of what the salts leave."""
    salted = Window.partitionBy(key, F.pmod(F.xxhash64("call_id"), F.lit(SALTS))).orderBy(*order)
    left = x.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= F.col(k)).drop("_r")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= F.col(k)).drop("_r")


def quotas(s: DataFrame, size: int) -> DataFrame:
    """(key, pool, quota): equal quotas, the remainder one each to the largest strata. There are a few rows per stratum."""
    pools = s.groupBy("key").agg(F.count(F.lit(1)).alias("pool"))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    base = F.floor(F.lit(size) / n)
    rank = F.row_number().over(Window.orderBy(F.col("pool").desc(), "key"))
    return pools.select("key", "pool", (base + (rank <= F.lit(size) - base * n).cast("int")).alias("quota"))


def stratified(calls_: DataFrame, size: int = SIZE) -> DataFrame:
    """(call_id, key, top_up): the quota of every stratum, topped up from the rest where strata are too small."""
    s = strata(calls_)
    drawn = top_per_key(s.join(F.broadcast(quotas(s, size)), "key"), "key", ["draw", "call_id"], "quota").select("call_id", "key", "draw", F.lit(False).alias("top_up"))
    # at most size rows are taken, so what is missing is counted in one row
    missing = drawn.agg((F.lit(size) - F.count(F.lit(1))).alias("missing"))
    rest = s.join(F.broadcast(drawn.select("call_id")), "call_id", "left_anti").orderBy("draw", "call_id").limit(size)
    rest = rest.join(F.broadcast(missing)).withColumn("_r", F.row_number().over(Window.orderBy("draw", "call_id"))).where(F.col("_r") <= F.col("missing"))
    return drawn.unionByName(rest.select("call_id", "key", "draw", F.lit(True).alias("top_up")))


def sliced(sample: DataFrame, parts: int = SLICES) -> DataFrame:
    """The sample, which is small, dealt round robin into disjoint slices."""
    return sample.withColumn("slice", F.pmod(F.row_number().over(Window.orderBy("top_up", "key", "draw", "call_id")) - 1, F.lit(parts)))


def q_band_lookup(spark, sf_dir):
    return C.calls(spark, sf_dir).groupBy(band(F.col("asr_confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def q_hash_sample(spark, sf_dir):
    return C.calls(spark, sf_dir).where(S.draw(F.concat(F.lit("sample:"), "call_id")) < RATE).select("call_id")


def q_sample_quotas(spark, sf_dir):
    return quotas(strata(C.calls(spark, sf_dir)), SIZE)


def q_stratified_sample(spark, sf_dir):
    return stratified(C.calls(spark, sf_dir)).select("call_id", "key", "top_up")


def q_round_robin_slices(spark, sf_dir):
    return sliced(stratified(C.calls(spark, sf_dir))).select("call_id", "slice")


_ST = f"""{C.CALLS_CTE}, st as (select call_id, coalesce(stratum, '') || '/' || case when asr_confidence >= 0.85 and asr_confidence < 1.01 then 'clean' when asr_confidence >= 0.7 and asr_confidence < 0.85 then 'mixed' when asr_confidence >= 0 and asr_confidence < 0.7 then 'degraded' else 'clean' end key, {FNV.format("'draw:' || call_id")} draw from calls
), po as (select key, count(*) pool from st group by 1
), qu as (select key, pool, floor(24 / count(*) over ()) + case when row_number() over (order by pool desc, key) <= 24 - floor(24 / count(*) over ()) * count(*) over () then 1 else 0 end quota from po
), dr as (select s.*, false top_up from (select st.*, quota, row_number() over (partition by st.key order by draw, call_id) r from st join qu on qu.key = st.key) s where r <= quota
), re as (select *, true top_up from (select *, row_number() over (order by draw, call_id) r from st where call_id not in (select call_id from dr)) where r <= 24 - (select count(*) from dr)
), sa as (select call_id, key, draw, top_up from dr union all select call_id, key, draw, top_up from re)"""
QUERIES = {"band_lookup": q_band_lookup, "hash_sample": q_hash_sample, "sample_quotas": q_sample_quotas, "stratified_sample": q_stratified_sample, "round_robin_slices": q_round_robin_slices}
SQL = {
    "band_lookup": f"with {_ST} select split_part(key, '/', 2) band, count(*) n from st group by 1",
    "hash_sample": f"with {C.CALLS_CTE} select call_id from calls where {FNV.format(chr(39) + 'sample:' + chr(39) + ' || call_id')} / 4294967296 < 0.1",
    "sample_quotas": f"with {_ST} select key, pool, quota::bigint quota from qu",
    "stratified_sample": f"with {_ST} select call_id, key, top_up from sa",
    "round_robin_slices": f"with {_ST} select call_id, ((row_number() over (order by top_up, key, draw, call_id) - 1) % 4)::int slice from sa",
}
