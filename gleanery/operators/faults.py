"""Known faults put into cells by a pure function of their key, and the account of what became of them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.common import folded, table
from gleanery.functions import scalars as S

from . import cells as C
from .evaluation import NUMBERS, SCORED_CTE, gold_long, scored
from .texts import FNV

SEED, RATES, DROP_SHARE = 7, (0.05, 0.1, 0.2), 0.2


def perturbed(number: Column, key: Column) -> Column:
    """The number with one digit changed, never the leading one; a single digit is counted up."""
    digits = F.floor(F.abs(number)).cast("bigint").cast("string")
    at = 2 + F.floor(S.draw(F.concat(key, F.lit(":pos"))) * (F.length(digits) - 1)).cast("int")
    was = F.substring(digits, at, F.lit(1)).try_cast("int")
    digit = ((was + 1 + F.floor(S.draw(F.concat(key, F.lit(":val"))) * 8)) % 10).cast("string")
    changed = F.concat(F.substring(digits, F.lit(1), at - 1), digit, F.substring(digits, at + 1, F.length(digits)))
    return F.when(F.length(digits) < 2, (number + 1).cast("bigint").cast("string")).otherwise(F.concat(F.when(number < 0, "-").otherwise(""), changed))


def injected(cells_: DataFrame, fields: DataFrame, rate: float, seed: int = SEED) -> DataFrame:
    """The cells with faulted (the value after injection) and kind (null: left alone)."""
    x = cells_.join(fields.select("field", F.col("type").alias("_type"), F.col("enum_values").alias("_enum")), "field", "left")
    key = F.concat(F.lit(f"{seed}:"), "call_id", F.lit(":"), "field")
    hit = F.col("value").isNotNull() & (S.draw(F.concat(F.lit("fault:"), key)) < rate)
    d = S.draw(F.concat(F.lit("fault-kind:"), key))
    number = F.col("value").try_cast("double")
    others = F.filter(F.coalesce("_enum", F.array().cast("array<string>")), lambda v: v != F.col("value"))
    other = F.get(others, F.pmod(F.floor(d * F.size(others)), F.greatest(F.size(others), F.lit(1))).cast("int"))
    to = F.when(F.col("_type") == "number", perturbed(number, F.concat(F.lit("fault-digit:"), key))).when(F.col("_type") == "boolean", F.when(F.col("value") == "true", "false").otherwise("true")).otherwise(other)
    drop = (d < DROP_SHARE) | ((F.col("_type") == "number") & number.isNull())
    kind = F.when(hit & drop, "drop").when(hit & to.isNotNull(), F.when(F.col("_type") == "number", "digit").otherwise("substitute"))
    return x.withColumn("kind", kind).withColumn("faulted", F.when(kind == "drop", None).when(kind.isNotNull(), to).otherwise(F.col("value"))).drop("_type", "_enum")


def recovery(clean: DataFrame, faults: DataFrame, gold: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Counts of what became of the injected faults.

    unscored: a column without gold; already_wrong: wrong before; detectable: the rest; surfaced: still scored as an error; repaired: right
    again, by the table repaired (call_id, field, value) or by chance; lost: neither, which must be none.
    """
    f = faults.where("kind is not null").select("call_id", "field", "faulted")
    if repaired is not None:
        f = f.join(repaired.select("call_id", "field", F.col("value").alias("_fixed"), F.lit(True).alias("_done")), ["call_id", "field"], "left").withColumn("faulted", F.when(F.coalesce("_done", F.lit(False)), F.col("_fixed")).otherwise(F.col("faulted")))
    x = f.join(clean.select("call_id", "field", "right"), ["call_id", "field"], "left").join(gold, ["call_id", "field"], "left")
    now = F.nullif(folded("faulted"), F.lit(""))
    same = F.when(F.col("field").isin(NUMBERS), S.same_number(F.col("gold"), now)).otherwise(F.col("gold") == now)
    x = x.withColumn("now", F.coalesce(same, F.lit(False)) | (F.col("gold").isNull() & now.isNull())).withColumn("scored", F.col("right").isNotNull())
    n = lambda c, name: F.count_if(c).alias(name)
    live = F.col("scored") & F.coalesce("right", F.lit(False))
    out = x.agg(F.count(F.lit(1)).alias("injected"), n(~F.col("scored"), "unscored"), n(F.col("scored") & ~F.coalesce("right", F.lit(True)), "already_wrong"), n(live, "detectable"), n(live & ~F.col("now"), "surfaced"), n(live & F.col("now"), "repaired"))
    return out.withColumn("lost", F.col("detectable") - F.col("surfaced") - F.col("repaired"))


def q_fault_injection(spark, sf_dir):
    x = injected(C.cells(spark, sf_dir), table(spark, sf_dir, "schema_fields"), RATES[1])
    return x.where("kind is not null").select("call_id", "field", "kind", F.col("value").alias("from_value"), F.col("faulted").alias("to_value"))


def q_fault_recovery(spark, sf_dir):
    clean, gold, cells_, fields = scored(spark, sf_dir), gold_long(spark, sf_dir), C.cells(spark, sf_dir), table(spark, sf_dir, "schema_fields")
    out = None
    for rate in RATES:
        r = recovery(clean, injected(cells_, fields, rate), gold).withColumn("rate", F.lit(rate))
        out = r if out is None else out.unionByName(r)
    return out


def _draw(kind):
    return f"({FNV.format(chr(39) + kind + ':7:' + chr(39) + ' || call_id || ' + chr(39) + ':' + chr(39) + ' || field')} / 4294967296)"


def _sub(kind, tail):
    return f"({FNV.format(chr(39) + kind + ':7:' + chr(39) + ' || call_id || ' + chr(39) + ':' + chr(39) + ' || field || ' + chr(39) + tail + chr(39))} / 4294967296)"


_FA = f"""fa0 as (select c.call_id, c.field, c.value, s.type, list_filter(coalesce(s.enum_values, []), lambda v: v <> c.value) alt, try_cast(c.value as double) num from cells c left join schema_fields s on s.field = c.field where c.value is not null
), fa1 as (select *, {_draw('fault')} d, {_draw('fault-kind')} k, floor(abs(num))::bigint::varchar digits from fa0
), fa2 as (select *, 2 + floor({_sub('fault-digit', ':pos')} * (length(digits) - 1))::int digit_at from fa1
), fa3 as (select *, case when type = 'number' then case when length(digits) < 2 then (num + 1)::bigint::varchar else case when num < 0 then '-' else '' end || substr(digits, 1, digit_at - 1) || ((substr(digits, digit_at, 1)::int + 1 + floor({_sub('fault-digit', ':val')} * 8)::int) % 10)::varchar || substr(digits, digit_at + 1) end
    when type = 'boolean' then case when value = 'true' then 'false' else 'true' end else alt[floor(k * len(alt))::int % greatest(len(alt), 1) + 1] end as target from fa2
), fa as (select *, case when k < 0.2 or (type = 'number' and num is null) then 'drop' when target is not null then case when type = 'number' then 'digit' else 'substitute' end end kind from fa3)"""
_NOW = f"nullif({C.FOLD.format('f.target')}, '')"
_REC = f"""rec as (select rate, s."right" r, s.call_id is not null scored, coalesce(case when f.field = 'dollar_amount' then abs(try_cast(replace(s.gold, ',', '') as double) - try_cast(replace(case when f.kind <> 'drop' then {_NOW} end, ',', '') as double)) < 0.005 else s.gold = case when f.kind <> 'drop' then {_NOW} end end, false) or (s.gold is null and case when f.kind <> 'drop' then {_NOW} end is null) now
  from fa f join (select unnest([0.05, 0.1, 0.2])::double rate) on f.d < rate left join sc s on s.call_id = f.call_id and s.field = f.field where f.kind is not null
), rn as (select rate, count(*) injected, count(*) filter (not scored) unscored, count(*) filter (scored and not r) already_wrong, count(*) filter (scored and r) detectable, count(*) filter (scored and r and not now) surfaced, count(*) filter (scored and r and now) repaired from rec group by 1)"""
QUERIES = {"fault_injection": q_fault_injection, "fault_recovery": q_fault_recovery}
SQL = {
    "fault_injection": f"with {C.CELLS_CTE}, {_FA} select call_id, field, kind, value as from_value, case when kind <> 'drop' then target end to_value from fa where d < 0.1 and kind is not null",
    "fault_recovery": f"with {SCORED_CTE}, {_FA}, {_REC} select *, detectable - surfaced - repaired lost from rn",
}
