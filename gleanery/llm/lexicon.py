"""Problem 1: how often every distinct value or word occurs and in how many calls, and which are too rare or too common.

Per-record term counts are emitted as rows, combined by hash within each task before they are shuffled (Spark's
partial aggregation), and summed per field, term and call; a second sum per field and term gives occurrences
and calls. The first level is keyed by call as well, so a term that a third of all rows hold is spread over
all tasks, and reaches the second level as one partial row per task.

Repeated rows: a record is a call with a value of the field (folded; for the notes, the text in lower case), and counts once
however often it was delivered. Null and blank values are no values. A note without any word is a value with no term.
Empty tables give no rows; columns of other names are ignored.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.common import folded, table

RARE_CALLS, COMMON_SHARE_PERCENT = 2, 25


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, call_id, terms), one row per distinct record."""
    gold = table(spark, sf_dir, "gold").select("call_id", F.explode(F.create_map(F.lit("reason"), folded("reason"), F.lit("objection"), folded("objection"))).alias("field_name", "v"))
    notes = table(spark, sf_dir, "validated_cells").where("field = 'issue_note'").select("call_id", F.lit("value").alias("field_name"), folded("value").alias("v"))
    once = gold.unionByName(notes).where("v <> ''").distinct()
    words = F.when(F.col("field_name") == "value", F.regexp_extract_all("v", F.lit("([a-z0-9]+)"))).otherwise(F.array("v"))
    return once.select("field_name", "call_id", words.alias("terms"))


def frequencies(recs: DataFrame, rare_calls: int = RARE_CALLS, common_percent: float = COMMON_SHARE_PERCENT) -> DataFrame:
    """(field_name, term, occurrences, calls, field_calls, mark) of records (field_name, call_id, terms); mark is null for a term of use."""
    # the empty term stands for the call itself: its calls are the calls of the field
    terms = recs.select("field_name", "call_id", F.explode(F.concat(F.array(F.lit("")), F.coalesce("terms", F.array()))).alias("term"))
    per_call = terms.groupBy("field_name", "term", "call_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per_call.groupBy("field_name", "term").agg(F.sum("n").alias("occurrences"), F.count("call_id").alias("calls"))
    field_calls = counts.where("term = ''").select("field_name", F.col("calls").alias("field_calls"))
    # one row per field name, of which there are three
    marked = counts.where("term <> ''").join(F.broadcast(field_calls), "field_name")
    rare, common = F.col("calls") <= rare_calls, F.col("calls") * 100 > F.col("field_calls") * common_percent
    return marked.withColumn("mark", F.when(rare, "rare").when(common, "common"))


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequencies(records(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


_COUNTED = r"""
with rec as (
  select distinct * from (
    select call_id, 'reason' field_name, lower(regexp_replace(reason, '^\s+|\s+$', '', 'g')) v from gold
    union all select call_id, 'objection', lower(regexp_replace(objection, '^\s+|\s+$', '', 'g')) from gold
    union all select call_id, 'value', lower(regexp_replace(value, '^\s+|\s+$', '', 'g')) from validated_cells where field = 'issue_note'
  ) where v <> ''
), terms as (
  select call_id, field_name, v term from rec where field_name <> 'value'
  union all select call_id, 'value', unnest(regexp_extract_all(v, '[a-z0-9]+')) from rec where field_name = 'value'
), totals as (select field_name, count(distinct call_id) field_calls from rec group by 1
), counted as (
  select t.field_name, term, count(*) occurrences, count(distinct call_id) calls, any_value(field_calls) field_calls
  from terms t join totals o on o.field_name = t.field_name group by 1, 2
)
select *, case when calls <= 2 then 'rare' when calls > 0.25 * field_calls then 'common' end mark from counted
"""
SQL = {"p1_terms": _COUNTED, "p1_found": f"select field_name, term, mark from ({_COUNTED}) where mark is not null"}
QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}
