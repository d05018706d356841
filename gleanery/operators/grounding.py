"""Whether what a cell quotes is in its call: exact in the cited turn, elsewhere, or with words left out.

Cells meet their call by one join on call_id; all spans of a cell are checked in place against the call's normalised turns, which are
computed once per call. A cell without a call has empty turns, so its quotes are found nowhere.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.common import table
from gleanery.functions import scalars as S

from . import cells as C


def turns_of_calls(spark, sf_dir) -> DataFrame:
    """(call_id, texts, turn_words): each call's normalised turns and their words, in order as delivered."""
    t = table(spark, sf_dir, "transcripts").where("call_id is not null").groupBy("call_id").agg(F.min_by(F.struct("turns"), F.struct("ingested_at", "pos")).alias("c"))
    texts = F.transform(F.coalesce("c.turns", F.array().cast("array<struct<t:int,speaker:string,text:string>>")), lambda x: S.normalized(F.coalesce(x["text"], F.lit(""))))
    x = t.select("call_id", texts.alias("texts"))
    return x.withColumn("turn_words", F.transform("texts", lambda w: F.split(w, " ")))


def located(e, texts, words):
    """Of one span: (here, elsewhere, somewhere) for exact places and in_order for its words in the order of some turn."""
    needle = S.normalized(F.coalesce(e["quote"], F.lit("")))
    here = (needle != "") & F.coalesce(F.contains(F.get(texts, e["turn_index"]), needle), F.lit(False))
    some = (needle != "") & F.exists(texts, lambda t: F.contains(t, needle))
    ordered = F.exists(texts, lambda t: S.is_subsequence(F.split(needle, " "), F.split(t, " "))) if words is None else F.exists(words, lambda h: S.is_subsequence(F.split(needle, " "), h))
    order = some | ((needle != "") & ordered)
    return F.struct(here.alias("here"), some.alias("some"), order.alias("in_order"))


def grounded(cells_: DataFrame, calls_: DataFrame, fields: DataFrame) -> DataFrame:
    """The cells with their checks, what is fatal, what is suspicious and whether they claim an absence."""
    return checked(cells_.join(calls_, "call_id", "left"), fields)


def checked(cells_: DataFrame, fields: DataFrame, split: bool = True) -> DataFrame:
    """The same of cells that carry their call's normalised texts and, where split, turn_words."""
    vocab = fields.select("field", F.col("type").alias("_type"), F.col("enum_values").alias("_enum"))
    x = cells_.join(vocab, "field", "left")
    none = F.array().cast("array<string>")
    spans = F.transform(F.coalesce("evidence", F.array().cast("array<struct<quote:string,turn_index:int>>")), lambda e: located(e, F.coalesce("texts", none), F.coalesce("turn_words", F.array().cast("array<array<string>>")) if split else None))
    x = x.withColumn("spans", spans).drop("texts", "turn_words")
    any_span = F.size("spans") > 0
    x = x.withColumn("absence_claim", F.col("value").isNull() | ((F.col("_type") == "boolean") & (F.col("value") == "false")))
    x = x.withColumn("absence_claim", F.coalesce("absence_claim", F.lit(False)))
    x = x.withColumn("quote_found", any_span & F.forall("spans", lambda s: s["here"])).withColumn("quote_found_elsewhere", F.exists("spans", lambda s: ~s["here"] & s["some"]))
    x = x.withColumn("quote_is_subsequence", any_span & F.forall("spans", lambda s: s["in_order"])).withColumn("has_evidence", any_span | F.col("absence_claim"))
    free = F.col("value").isNull() | (F.coalesce("_type", F.lit("")) != "enum") | (F.coalesce(F.size("_enum"), F.lit(0)) <= 0)
    x = x.withColumn("value_in_schema", free | F.coalesce(F.array_contains("_enum", F.col("value")), F.lit(False)))
    fatal = F.when(~F.col("has_evidence"), "no evidence").when(F.exists("spans", lambda s: ~s["in_order"]), "not in the call")
    x = x.withColumn("fatal", fatal)
    odd = F.col("fatal").isNotNull() | (~F.col("absence_claim") & (~F.col("quote_found") | ~F.col("value_in_schema")))
    return x.withColumn("suspicious", odd).drop("spans", "_type", "_enum")


CHECKS = ["quote_found", "quote_found_elsewhere", "quote_is_subsequence", "value_in_schema", "has_evidence", "fatal", "suspicious", "absence_claim"]


def grounded_cells(spark, sf_dir) -> DataFrame:
    return grounded(C.cells(spark, sf_dir), turns_of_calls(spark, sf_dir), table(spark, sf_dir, "schema_fields"))


def q_grounding(spark, sf_dir):
    return grounded_cells(spark, sf_dir).select("call_id", "field", *CHECKS)


def q_grounding_summary(spark, sf_dir):
    return grounded_cells(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(c) for c in CHECKS if c != "fatal"), F.count("fatal").alias("fatal"))


def q_context_window(spark, sf_dir):
    """The cited turn of each span with two turns on either side, as the second reader sees it."""
    t = table(spark, sf_dir, "transcripts").where("call_id is not null").groupBy("call_id").agg(F.min_by(F.struct("turns"), F.struct("ingested_at", "pos")).alias("c"))
    e = C.cells(spark, sf_dir).select("call_id", "field", F.posexplode("evidence").alias("span", "e")).where("e.turn_index >= 0")
    x = e.join(t, "call_id").select("call_id", "field", "span", F.col("e.turn_index").alias("turn_index"), F.col("c.turns").alias("turns"))
    first = F.greatest(F.lit(0), F.col("turn_index") - 2)
    window = F.slice("turns", first + 1, F.greatest(F.lit(0), F.col("turn_index") + 3 - first))
    return x.select("call_id", "field", "span", "turn_index", F.array_join(F.transform(window, lambda w: F.coalesce(w["text"], F.lit(""))), "\n").alias("context"))


_N = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[—–]', ' ', 'g'), '[^a-z0-9$\[\]'' ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
QUERIES = {"grounding": q_grounding, "grounding_summary": q_grounding_summary, "context_window": q_context_window}
_SUBSEQ = r"'(^| )' || array_to_string(list_transform(string_split(e.q, ' '), lambda w: regexp_escape(w)), '( | .* )') || '( |$)'"
GROUNDED_CTE = f"""{C.CALLS_CTE}, {C.CELLS_CTE}, ct as (select call_id, list_transform(turns, lambda t: {_N.format("coalesce(t.text, '')")}) texts from calls
), sp as (
  select c.call_id, c.field, list_transform(coalesce(c.evidence, []), lambda e: {{'q': {_N.format("coalesce(e.quote, '')")}, 'i': e.turn_index}}) sp, coalesce(t.texts, []) texts from cells c left join ct t on t.call_id = c.call_id
), lo as (
  select call_id, field, list_transform(sp, lambda e: {{'here': e.q <> '' and e.i >= 0 and coalesce(contains(texts[e.i + 1], e.q), false), 'some': e.q <> '' and len(list_filter(texts, lambda t: contains(t, e.q))) > 0,
    'ord': e.q <> '' and len(list_filter(texts, lambda t: contains(t, e.q) or regexp_matches(t, {_SUBSEQ}))) > 0}}) s from sp
), ch as (
  select c.*, s.type, s.enum_values, l.s, coalesce(c.value is null or (s.type = 'boolean' and c.value = 'false'), false) absence_claim from cells c join lo l on l.call_id = c.call_id and l.field = c.field left join schema_fields s on s.field = c.field
), g as (
  select *, len(s) > 0 and len(list_filter(s, lambda e: not e.here)) = 0 quote_found, len(list_filter(s, lambda e: not e.here and e.some)) > 0 quote_found_elsewhere, len(s) > 0 and len(list_filter(s, lambda e: not e.ord)) = 0 quote_is_subsequence,
    value is null or type is distinct from 'enum' or coalesce(len(enum_values), 0) = 0 or list_contains(enum_values, value) value_in_schema, len(s) > 0 or absence_claim has_evidence from ch
), gr as (select *, fatal is not null or (not absence_claim and (not quote_found or not value_in_schema)) suspicious from (select *, case when not has_evidence then 'no evidence' when len(list_filter(s, lambda e: not e.ord)) > 0 then 'not in the call' end fatal from g))"""
SQL = {
    "grounding": f"with {GROUNDED_CTE} select call_id, field, {', '.join(CHECKS)} from gr",
    "grounding_summary": f"with {GROUNDED_CTE} select field, count(*) n, {', '.join(f'count(*) filter ({c}) {c}' for c in CHECKS if c != 'fatal')}, count(fatal) fatal from gr group by 1",
    "context_window": f"""with {C.CALLS_CTE}, {C.CELLS_CTE}, e as (select call_id, field, i - 1 as span, evidence[i].turn_index turn_index from (select *, unnest(generate_series(1, len(evidence))) i from cells where len(evidence) > 0) where evidence[i].turn_index >= 0)
select e.call_id, field, span, turn_index, coalesce(array_to_string(list_transform(turns[greatest(0, turn_index - 2) + 1 : turn_index + 3], lambda w: coalesce(w.text, '')), chr(10)), '') context from e join calls c on c.call_id = e.call_id""",
}
