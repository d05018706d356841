"""Reading values out of calls: cue tables, scored categories with a runner-up, first cues, sums and dates; second readings and repairs.

A cue table is data: (detector, value, text) lines, here the quotes that accepted cells give as evidence. Whole calls are scored in
place (categories.py), one row per call, so the texts are shuffled once, to find a call's first delivery; category_scores and
best_two say the same as a join of turn tokens with the cues and two aggregates. A token of every category weighs next to nothing.
The cue table has a row per category and token of the schema's enumerated values.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.common import durable, folded, table
from gleanery.functions import scalars as S

from . import cells as C
from .categories import with_categories, words
from .texts import TURNS_CTE, _STOP, _TOKENS, _turns

#: Cues of the yes-or-no columns, in the order in which they are tried; our own.
PHRASES = [
    ("disclosure_given", 0, "kept for training"),
    ("disclosure_given", 1, "fee schedule may change"),
    ("disclosure_given", 2, "grace period"),
    ("escalation_requested", 0, "in charge"),
    ("escalation_requested", 1, "your boss"),
    ("escalation_requested", 2, "a supervisor"),
    ("hold", 0, "thanks for holding"),
    ("hold", 1, "bear with me"),
    ("audio_gap", 0, "[inaudible"),
    ("audio_gap", 1, "[unclear"),
]
PHRASE_SCHEMA = "detector string, cue_ord int, cue string"


def cue_lines(spark, sf_dir) -> DataFrame:
    """(detector, value, text): what accepted cells of enumerated fields quote."""
    kinds = table(spark, sf_dir, "schema_fields").where("type = 'enum'").select("field", F.explode("enum_values").alias("value"))
    v = table(spark, sf_dir, "validated_cells").where("call_id is not null and field is not null")
    # the first load decides, so all of them meet, but only what an accepted one quotes travels
    quotes = F.when(F.regexp_replace(folded("disposition"), "-", "_") == "accepted", F.transform("evidence", lambda e: e["quote"]))
    v = v.join(F.broadcast(kinds.select("field").distinct()), "field", "left_semi").select("call_id", "field", "load_no", "loaded_at", "value", quotes.alias("quotes"))
    c = v.groupBy("call_id", "field").agg(F.min_by(F.struct("value", "quotes"), F.struct("load_no", "loaded_at")).alias("c")).select("field", "c.*").where("quotes is not null")
    return c.join(kinds, ["field", "value"], "left_semi").select(F.col("field").alias("detector"), "value", F.explode("quotes").alias("text"))


def cue_table(lines: DataFrame) -> DataFrame:
    """(detector, value, token, weight, total): ln((n + 1) / (df + 0.5)) over a detector's n categories of which df have the token."""
    t = durable(lines.select("detector", "value", F.explode(S.tokens(F.col("text"))).alias("token")).distinct())
    n = t.groupBy("detector").agg(F.countDistinct("value").alias("n"))
    df = t.groupBy("detector", "token").agg(F.count(F.lit(1)).alias("df"))
    w = t.join(df, ["detector", "token"]).join(n, "detector").withColumn("weight", F.log((F.col("n") + 1) / (F.col("df") + 0.5)))
    w = w.where("weight > 0")
    return w.withColumn("total", F.sum("weight").over(Window.partitionBy("detector", "value"))).select("detector", "value", "token", "weight", "total")


def category_scores(turns: DataFrame, cues: DataFrame) -> DataFrame:
    """(key, turn_index, detector, value, hit, score) of turns (key, turn_index, turns, text): cue mass hit over all, weighted by place in the call."""
    t = turns.select("key", "turn_index", "turns", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("token"))
    hit = t.join(cues, "token").groupBy("key", "turn_index", "detector", "value").agg(F.sum("weight").alias("hit"), F.first("total").alias("total"), F.first("turns").alias("turns"))
    fraction = F.col("turn_index") / F.greatest(F.col("turns") - 1, F.lit(1))
    place = F.when(F.col("detector") == "reason", S.position_weight(fraction, True)).when(F.col("detector") == "outcome", S.position_weight(fraction, False)).otherwise(1.0)
    return hit.select("key", "turn_index", "detector", "value", "hit", (F.round(F.col("hit") / F.col("total") * place, 9)).alias("score"))


def best_two(scores: DataFrame) -> DataFrame:
    """(key, detector, value, turn_index, hit, score, runner_up, margin): the best category and the next; ties go to the earlier turn, then by name."""
    best = scores.groupBy("key", "detector", "value").agg(F.max(F.struct("score", (-F.col("turn_index")).alias("t"), "hit")).alias("b"))
    best = best.select("key", "detector", "value", "b.score", (-F.col("b.t")).alias("turn_index"), "b.hit")
    # a call has at most as many rows here as the detectors have categories
    r = best.withColumn("rank", F.row_number().over(Window.partitionBy("key", "detector").orderBy(F.col("score").desc(), "turn_index", "value"))).where("rank <= 2")
    one = r.groupBy("key", "detector").agg(F.max_by(F.struct("value", "turn_index", "hit", "score"), -F.col("rank")).alias("a"), F.max(F.when(F.col("rank") == 2, F.struct("value", "score"))).alias("z"))
    return one.select("key", "detector", "a.*", F.col("z.value").alias("runner_up"), (F.col("a.score") - F.coalesce("z.score", F.lit(0.0))).alias("margin"))


def first_cues(turns: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, detector, turn_index, cue): the first listed cue that occurs, in its first turn."""
    hit = turns.join(F.broadcast(phrases), F.contains(F.lower("text"), F.col("cue")))
    return hit.groupBy("key", "detector").agg(F.min(F.struct("cue_ord", "turn_index", "cue")).alias("c")).select("key", "detector", "c.turn_index", "c.cue")


def call_turns(spark, sf_dir) -> DataFrame:
    t = _turns(spark, sf_dir)
    sizes = t.groupBy("call_id").agg((F.max("turn_index") + 1).alias("turns"))
    return t.join(sizes, "call_id").withColumnRenamed("call_id", "key")


def _phrases(spark) -> DataFrame:
    return spark.createDataFrame(PHRASES, PHRASE_SCHEMA)


def call_texts(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """(call_id, pos, stratum, captured_at, asr_confidence, texts): a row per call as first delivered, with the texts of its turns in order; of the calls in only, if given (few)."""
    t = table(spark, sf_dir, "transcripts").where("call_id is not null")
    t = t if only is None else t.join(F.broadcast(only.select("call_id")), "call_id", "left_semi")
    t = t.withColumn("texts", F.transform("turns", lambda x: x["text"]))
    return t.groupBy("call_id").agg(F.min_by(F.struct("pos", "stratum", "captured_at", "asr_confidence", "texts"), F.struct("ingested_at", "pos")).alias("c")).select("call_id", "c.*")


def first_cue(low: Column, cues: Column) -> Column:
    """Of listed cues (cue_ord, cue, value) the first that occurs in the texts, with its first turn: (cue_ord, turn_index, cue, value), or null."""
    at = lambda c: F.array_position(F.transform(low, lambda t: F.contains(t, c["cue"])), F.lit(True)).cast("int") - 1
    hits = F.transform(cues, lambda c: F.struct(c["cue_ord"].alias("cue_ord"), at(c).alias("turn_index"), c["cue"].alias("cue"), c["value"].alias("value")))
    return F.array_min(F.filter(hits, lambda h: h["turn_index"] >= 0))


def read_calls(calls_: DataFrame, cues: DataFrame, fields: DataFrame) -> DataFrame:
    """calls_ (as of call_texts) with field, value, confidence, evidence, strength, margin: one row per call and detector, null where nothing was found."""
    names = fields.where("field = 'competitor'").select(F.posexplode("enum_values").alias("cue_ord", "value"))
    names = names.agg(F.collect_list(F.struct("cue_ord", F.lower("value").alias("cue"), "value")).alias("names"))
    own = sorted({p[0] for p in PHRASES} | {"competitor", "dollar_amount", "commitment_date"})
    kinds = fields.where("type = 'enum' and field <> 'competitor'").agg(F.collect_set("field").alias("kinds")).select(F.array_union(F.array(*map(F.lit, own)), "kinds").alias("detectors"))
    # settings: one row of a few names
    x = with_categories(calls_.withColumn("words", words(F.col("texts"))), cues).join(F.broadcast(names)).join(F.broadcast(kinds)).withColumn("low", F.transform("texts", F.lower))
    said = lambda i: F.get("texts", i)
    cell = lambda detector, value, turn, quote, mass, margin: F.struct(F.lit(detector).alias("detector") if isinstance(detector, str) else detector.alias("detector"), value.alias("value"), turn.cast("int").alias("turn_index"), quote.alias("quote"), mass.alias("mass"), margin.alias("margin"))
    cats = F.transform(F.filter("cats", lambda c: c["detector"] != "competitor"), lambda c: cell(c["detector"], c["value"], c["turn_index"], said(c["turn_index"]), S.saturated(c["hit"]), c["margin"]))
    cued = [(d, first_cue(F.col("low"), F.array(*(F.struct(F.lit(o).alias("cue_ord"), F.lit(c).alias("cue"), F.lit("true").alias("value")) for p, o, c in PHRASES if p == d)))) for d in sorted({p[0] for p in PHRASES})]
    cued = [*cued, ("competitor", first_cue(F.col("low"), F.col("names")))]
    x = x.select("*", *(c.alias(f"_{d}") for d, c in cued))
    cued = [F.when(F.col(f"_{d}").isNotNull(), cell(d, F.col(f"_{d}.value"), F.col(f"_{d}.turn_index"), S.window_quote(said(F.col(f"_{d}.turn_index")), F.col(f"_{d}.cue")), F.lit(0.9), F.lit(0.6))) for d, _ in cued]
    first = lambda what: F.get(F.filter(F.transform("texts", lambda t, i: F.struct(i.alias("i"), what(t).alias("v"))), lambda h: h["v"].isNotNull()), 0)
    x = x.withColumn("_sum", first(S.money)).withColumn("_date", first(lambda t: S.spoken_date(t, F.col("captured_at"))))
    sums = F.when(F.col("_sum").isNotNull(), cell("dollar_amount", F.col("_sum.v").cast("string"), F.col("_sum.i"), said(F.col("_sum.i")), F.lit(0.88), F.lit(0.5)))
    dates = F.when(F.col("_date").isNotNull(), cell("commitment_date", F.col("_date.v.date").cast("string"), F.col("_date.i"), said(F.col("_date.i")), F.col("_date.v.confidence"), F.col("_date.v.confidence") - 0.4))
    x = x.withColumn("found", F.concat(cats, F.filter(F.array(*cued, sums, dates), lambda f: f.isNotNull())))
    each = F.explode(F.transform("detectors", lambda d: F.struct(d.alias("field"), F.get(F.filter("found", lambda f: f["detector"] == d), 0).alias("f")))).alias("e")
    x = x.select(*calls_.columns, each).select(*calls_.columns, "e.field", "e.f.value", "e.f.turn_index", "e.f.quote", "e.f.mass", "e.f.margin")
    x = x.withColumn("strength", F.when(F.col("value").isNotNull(), F.greatest(F.lit(0.0), F.col("mass") - S.noise_penalty(F.col("quote")))))
    asr, boolean = F.coalesce("asr_confidence", F.lit(0.7)), F.col("field").isin(sorted({p[0] for p in PHRASES}))
    confidence = F.when(F.col("value").isNotNull(), S.shaped_confidence(F.col("strength"), F.col("margin"), asr)).when(boolean, S.shaped_confidence(F.lit(0.62), F.lit(0.2), asr)).otherwise(S.absence_confidence(asr))
    none = F.array().cast("array<struct<quote:string,turn_index:int>>")
    evidence = F.when(F.col("value").isNotNull(), F.array(F.struct("quote", "turn_index"))).otherwise(none)
    return x.select(*calls_.columns, "field", F.coalesce("value", F.when(boolean, "false")).alias("value"), confidence.alias("confidence"), evidence.alias("evidence"), "strength", "margin")


def extracted(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """(call_id, field, value, confidence, evidence, strength, margin): one cell per call and detector, null where nothing was found."""
    x = read_calls(call_texts(spark, sf_dir, only), cue_table(cue_lines(spark, sf_dir)), table(spark, sf_dir, "schema_fields"))
    return x.select("call_id", "field", "value", "confidence", "evidence", "strength", "margin")


def second_readings(cells_: DataFrame, context: DataFrame, cues: DataFrame) -> DataFrame:
    """(call_id, field, verdict, corrected): each categorical or numeric cell read again from its quote alone.

    A number that the window around the quote retracts is corrected; a quote that reads as another category, or as none, is rejected.
    context is (call_id, field, text), the cited turn and its neighbours.
    """
    spans = cells_.where("value is not null and value <> 'false' and size(evidence) > 0").select("call_id", "field", "value", F.col("evidence")[0]["quote"].alias("quote"))
    return reread(spans.join(context, ["call_id", "field"], "left"), cues).select("call_id", "field", "verdict", "corrected")


def reread(x: DataFrame, cues: DataFrame) -> DataFrame:
    """x (field, value, quote, text and more) with verdict and corrected, row by row; for rows with a value and a quote."""
    known = F.broadcast(cues.select(F.col("detector").alias("field"), F.lit(True).alias("categorical")).distinct())
    kept = x.columns
    x = with_categories(x.withColumn("words", words(F.array("quote"))), cues).join(known, "field", "left")
    read = F.get(F.filter("cats", lambda c: c["detector"] == F.col("field")), 0)["value"]
    x = x.withColumn("read", read).withColumn("r", S.retraction(F.coalesce("text", "quote")))
    retracted = F.coalesce(F.abs(S.number_in(F.col("value")) - F.col("r.retracted")) < 0.005, F.lit(False))
    other = F.coalesce("categorical", F.lit(False)) & (F.col("read").isNull() | (F.col("read") != F.col("value")))
    verdict = F.when(retracted | other, "reject").otherwise("accept")
    corrected = F.when(retracted, F.col("r.corrected").cast("string")).when(other, F.col("read")).otherwise(F.col("value"))
    return x.select(*kept, verdict.alias("verdict"), corrected.alias("corrected"))


def repaired(cells_: DataFrame, readings: DataFrame) -> DataFrame:
    """(call_id, field, value, confidence, evidence, outcome): a rejected cell takes the second reading, or concedes."""
    x = cells_.join(readings, ["call_id", "field"]).where("verdict = 'reject'")
    gone = F.col("corrected").isNull()
    none = F.array().cast("array<struct<quote:string,turn_index:int>>")
    return x.select("call_id", "field", F.col("corrected").alias("value"), F.when(gone, 0.3).otherwise(0.66).alias("confidence"), F.when(gone, none).otherwise(F.col("evidence")).alias("evidence"), F.when(gone, "human_review").otherwise("repaired").alias("outcome"))


def q_cue_table(spark, sf_dir):
    return cue_table(cue_lines(spark, sf_dir)).select("detector", "value", "token", F.round("weight", 6).alias("weight"))


def q_category_top2(spark, sf_dir):
    calls_ = call_texts(spark, sf_dir).select("call_id", words(F.col("texts")).alias("words"))
    b = with_categories(calls_, cue_table(cue_lines(spark, sf_dir))).select("call_id", F.explode("cats").alias("b"))
    return b.select("call_id", "b.detector", "b.value", "b.turn_index", F.round("b.score", 5).alias("score"), "b.runner_up")


def q_boolean_first_cue(spark, sf_dir):
    return first_cues(call_turns(spark, sf_dir), _phrases(spark)).withColumnRenamed("key", "call_id")


def q_extract_cells(spark, sf_dir):
    return extracted(spark, sf_dir).select("call_id", "field", "value", "confidence", "evidence")


def _readings(spark, sf_dir):
    from .grounding import q_context_window

    cells_ = C.cells(spark, sf_dir)
    context = q_context_window(spark, sf_dir).where("span = 0").select("call_id", "field", F.col("context").alias("text"))
    return cells_, second_readings(cells_, context, cue_table(cue_lines(spark, sf_dir)))


def q_second_readings(spark, sf_dir):
    return _readings(spark, sf_dir)[1]


def q_repairs(spark, sf_dir):
    return repaired(*_readings(spark, sf_dir))


_CUES = f"""{C.CELLS_CTE}, kinds as (select distinct field, unnest(enum_values) v from schema_fields where type = 'enum'
), li as (select c.field detector, c.value, unnest(evidence).quote as text from cells c where disposition = 'accepted' and (c.field, c.value) in (select (field, v) from kinds)
), tk as (select distinct detector, value, unnest({_TOKENS.format('text', _STOP)}) token from li
), dn as (select detector, count(distinct value) n from tk group by 1), df as (select detector, token, count(*) df from tk group by 1, 2
), cu as (select t.*, ln((n + 1) / (df + 0.5)) weight from tk t join dn on dn.detector = t.detector join df on df.detector = t.detector and df.token = t.token where ln((n + 1) / (df + 0.5)) > 0
), cues as (select *, sum(weight) over (partition by detector, value) total from cu)"""
_SCORES = f"""{TURNS_CTE}, {_CUES}, sz as (select call_id, max(turn_index) + 1 turns from turns group by 1
), tt as (select t.call_id, turn_index, turns, unnest(list_distinct({_TOKENS.format('text', _STOP)})) token from turns t join sz on sz.call_id = t.call_id
), hi as (select call_id, turn_index, detector, value, sum(weight) hit, any_value(total) total, any_value(turns) turns from tt join cues on cues.token = tt.token group by 1, 2, 3, 4
), so as (select *, round(hit / total * case detector when 'reason' then 1.25 - 0.5 * (turn_index / greatest(turns - 1, 1)) when 'outcome' then 0.75 + 0.5 * (turn_index / greatest(turns - 1, 1)) else 1.0 end::double, 9) score from hi
), be as (select *, row_number() over (partition by call_id, detector, value order by score desc, turn_index) r from so
), ra as (select *, row_number() over (partition by call_id, detector order by score desc, turn_index, value) k, lead(value) over (partition by call_id, detector order by score desc, turn_index, value) runner_up from be where r = 1)"""
_PH = "(select * from (values " + ", ".join(f"('{d}', {o}, '{c}')" for d, o, c in PHRASES) + ") p(detector, cue_ord, cue))"
QUERIES = {"cue_table": q_cue_table, "category_top2": q_category_top2, "boolean_first_cue": q_boolean_first_cue, "extract_cells": q_extract_cells, "second_readings": q_second_readings, "repairs": q_repairs}
SQL = {
    "cue_table": f"with {_CUES} select detector, value, token, round(weight, 6) weight from cues",
    "category_top2": f"with {_SCORES} select call_id, detector, value, turn_index, round(score, 5) score, runner_up from ra where k = 1",
    "boolean_first_cue": f"with {TURNS_CTE}, h as (select call_id, detector, turn_index, cue, row_number() over (partition by call_id, detector order by cue_ord, turn_index) r from turns join {_PH} on contains(lower(text), cue)) select call_id, detector, turn_index, cue from h where r = 1",
}
