"""Queries of the scalar functions over whole texts, and token statistics."""

from pyspark.sql import functions as F

from gleanery.common import table
from gleanery.functions import scalars as S


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "transcripts").where("call_id is not null").groupBy("call_id").agg(F.min_by(F.struct("captured_at", "turns"), F.struct("ingested_at", "pos")).alias("c"))
    return t.select("call_id", "c.captured_at", F.posexplode("c.turns").alias("turn_index", "turn")).select("call_id", "captured_at", "turn_index", F.col("turn.text").alias("text")).where("text is not null")


def q_normalize_text(spark, sf_dir):
    return _turns(spark, sf_dir).select("call_id", "turn_index", S.normalized(F.col("text")).alias("text"))


def q_tokenize_idf(spark, sf_dir):
    """Tokens of documents by the records that hold them: idf = ln((n + 1) / (df + 0.5))."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = d.agg(F.count(F.lit(1)).alias("n"))
    df = d.select(F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 0.5)), 6).alias("idf"))


def q_stem_counts(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.explode(S.tokens(F.col("text"))).alias("token"))
    return t.groupBy(S.stemmed(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


def q_name_tokens(spark, sf_dir):
    f = table(spark, sf_dir, "schema_fields")
    return f.select("field", F.explode(F.array_union(F.array("field"), F.coalesce("merged_from", F.array()))).alias("name")).select("field", "name", F.array_join(S.name_tokens(F.col("name")), " ").alias("tokens"))


def q_noise_marker_flags(spark, sf_dir):
    return _turns(spark, sf_dir).select("call_id", "turn_index", F.round(S.noise_penalty(F.col("text")), 6).alias("penalty")).where("penalty > 0")


def q_clean_quote(spark, sf_dir):
    c = table(spark, sf_dir, "validated_cells").select(F.explode("evidence").alias("e")).select("e.quote").distinct()
    return c.where("quote is not null").select("quote", S.clean_quote(F.col("quote")).alias("clean"))


def q_money_first_number(spark, sf_dir):
    return _turns(spark, sf_dir).select("call_id", "turn_index", S.money(F.col("text")).alias("amount")).where("amount is not null")


def q_spoken_dates(spark, sf_dir):
    x = _turns(spark, sf_dir).select("call_id", "turn_index", S.spoken_date(F.col("text"), F.col("captured_at")).alias("d"))
    return x.where("d is not null").select("call_id", "turn_index", "d.date", "d.confidence")


def q_day_of_month_rollover(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 31 + 1).cast("int").alias("day"))
    return o.select("o_orderkey", S.day_of_month(F.col("d"), F.col("day")).alias("next"))


def q_relative_weekday(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 7).cast("int").alias("w"), (F.col("o_custkey") % 2 == 0).alias("following"))
    return o.select("o_orderkey", S.relative_weekday(F.col("d"), F.col("w"), F.col("following")).alias("day"))


def q_fnv1a_draw(spark, sf_dir):
    c = table(spark, sf_dir, "gold").select("call_id").where("call_id is not null").distinct()
    return c.select("call_id", S.fnv1a(F.concat(F.lit("sample:"), "call_id")).alias("hash"))


def q_half_up(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 7).alias("x"))
    return p.select("p_partkey", S.half_up(F.col("x")).alias("rounded"))


TURNS_CTE = "raw as (select call_id, arg_min({'captured_at': captured_at, 'turns': turns}, (ingested_at, pos)) c from transcripts where call_id is not null group by 1), turns as (select call_id, captured_at, i - 1 turn_index, ts[i].text as text from (select call_id, c.captured_at captured_at, c.turns ts, unnest(generate_series(1, len(c.turns))) i from raw) where ts[i].text is not null)"
NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[—–]', ' ', 'g'), '[^a-z0-9$\[\]'' ]', ' ', 'g'), ' +', ' ', 'g'), ' ')"
_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
_TOKENS = r"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(lower({}), '\[[^\]]*\]', ' ', 'g'), '[^a-z0-9$''\- \t\n]', ' ', 'g'), '[ \t\n]+'), lambda w: regexp_replace(w, '^[-'']+|[-'']+$', '', 'g')), lambda w: length(w) >= 4 and not list_contains([{}], w))"
_STEM = "case " + " ".join(f"when ends_with(w, '{s}') and length(w) - {len(s)} >= 4 then left(w, length(w) - {len(s)})" + (" || 'y'" if s == "ies" else "") for s in S.SUFFIXES) + " else w end"
_MARK = r"\[(inaudible|crosstalk|static|unintelligible|background noise)\]"
_MONEY = r"\$?\b(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s?(k\b|dollars\b)?"
_MONTH, _DAY = "|".join(S.MONTHS), "|".join(S.WEEKDAYS)
_DOM = "case when date_trunc('month', {0})::date + ({1} - 1) >= {0} then date_trunc('month', {0})::date + ({1} - 1) else (date_trunc('month', {0}) + interval 1 month)::date + ({1} - 1) end"
_AHEAD = "case when ({1} - dayofweek({0}) + 7) % 7 = 0 then 7 else ({1} - dayofweek({0}) + 7) % 7 end"


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SPOKEN = rf"""select call_id, turn_index, case kind
  when 1 then (make_date(year(captured_at), list_position({_list(S.MONTHS)}, regexp_extract(x, p1, 1)), 1) + (regexp_extract(x, p1, 2)::int - 1))
  when 2 then captured_at + 1
  when 3 then {_DOM.format('captured_at', 'regexp_extract(x, p3, 1)::int')}
  when 4 then {_DOM.format('captured_at', 'regexp_extract(x, p4, 2)::int')}
  when 5 then {_DOM.format('captured_at', 'regexp_extract(x, p5, 1)::int')}
  else captured_at + ({_AHEAD.format('captured_at', f"(list_position({_list(S.WEEKDAYS)}, regexp_extract(x, p6, 2)) - 1)")} + case when kind = 6 then 7 else 0 end)::int end as date,
  [0.94, 0.9, 0.52, 0.88, 0.78, 0.61, 0.8][kind]::double confidence
from (select *, case when regexp_matches(x, p1) then 1 when regexp_matches(x, '\btomorrow\b') then 2 when regexp_matches(x, p3) then 3 when regexp_matches(x, p4) then 4 when regexp_matches(x, p5) then 5
    when regexp_matches(x, p6) and regexp_extract(x, p6, 1) = 'next' then 6 when regexp_matches(x, p6) then 7 end kind
  from (select *, lower(text) x, '\b({_MONTH})\s+(\d{{1,2}})(st|nd|rd|th)?\b' p1, '\bweek of the (\d{{1,2}})(st|nd|rd|th)?\b' p3, '\b({_DAY})\s+the\s+(\d{{1,2}})(st|nd|rd|th)?\b' p4, '\bthe (\d{{1,2}})(st|nd|rd|th)\b' p5, '\b(this|next)\s+({_DAY})\b' p6 from turns where captured_at is not null))
where kind is not null"""
FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({}, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
QUERIES = {
    "normalize_text": q_normalize_text,
    "tokenize_idf": q_tokenize_idf,
    "stem_counts": q_stem_counts,
    "name_tokens": q_name_tokens,
    "noise_marker_flags": q_noise_marker_flags,
    "clean_quote": q_clean_quote,
    "money_first_number": q_money_first_number,
    "spoken_dates": q_spoken_dates,
    "day_of_month_rollover": q_day_of_month_rollover,
    "relative_weekday": q_relative_weekday,
    "fnv1a_draw": q_fnv1a_draw,
    "half_up": q_half_up,
}
SQL = {
    "normalize_text": f"with {TURNS_CTE} select call_id, turn_index, {NORMAL.format('text')} as text from turns",
    "tokenize_idf": f"select token, df, round(ln(((select count(*) from documents) + 1) / (df + 0.5)), 6) idf from (select token, count(*) df from (select unnest(list_distinct({_TOKENS.format('text', _STOP)})) token from documents) group by 1)",
    "stem_counts": f"with {TURNS_CTE} select {_STEM} stem, count(*) n from (select unnest({_TOKENS.format('text', _STOP)}) w from turns) group by 1",
    "name_tokens": rf"""select field, name, array_to_string(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '\s+'), lambda w: length(w) > 2 and not list_contains([{_STOP}], w)), ' ') tokens
from (select distinct field, unnest(list_prepend(field, coalesce(merged_from, []))) as name from schema_fields)""",
    "noise_marker_flags": rf"with {TURNS_CTE} select * from (select call_id, turn_index, round(least(0.4, case when regexp_matches(text, '(?i){_MARK}') then 0.22 else 0 end + case when contains(text, '—') then 0.08 else 0 end + case when regexp_matches(text, '(?i)\bno sorry\b') then 0.1 else 0 end), 6)::double penalty from turns) where penalty > 0",
    "clean_quote": rf"""select quote, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(quote, '(?i){_MARK}\s*', '', 'g'), '(?i)\b([a-z'']+)—\s+', '', 'g'), '(?i)\b(um|uh|you know|i mean|sort of|kind of|like)\b,?\s*', '', 'g'), '\s+', ' ', 'g'), '\s+([,.?!])', '\1', 'g')) clean
from (select distinct e.quote as quote from (select unnest(evidence) e from validated_cells)) where quote is not null""",
    "money_first_number": rf"""with {TURNS_CTE} select call_id, turn_index, floor(v + 0.5)::bigint amount from (
  select *, try_cast(replace(regexp_extract(text, '(?i){_MONEY}', 1), ',', '') as double) * case when lower(regexp_extract(text, '(?i){_MONEY}', 2)) = 'k' then 1000 else 1 end v from turns where regexp_matches(text, '(?i)\$|dollar|\bk\b')) where v >= 20""",
    "spoken_dates": f"with {TURNS_CTE} {_SPOKEN}",
    "day_of_month_rollover": f"select o_orderkey, {_DOM.format('d', 'day')} as next from (select o_orderkey, o_orderdate::date d, (o_orderkey % 31 + 1)::int as day from orders)",
    "relative_weekday": f"select o_orderkey, d + ({_AHEAD.format('d', 'w')} + case when o_custkey % 2 = 0 then 7 else 0 end)::int as day from (select *, o_orderdate::date d, (o_orderkey % 7)::int w from orders)",
    "fnv1a_draw": f"select call_id, {FNV.format(chr(39) + 'sample:' + chr(39) + ' || call_id')} hash from (select distinct call_id from gold where call_id is not null)",
    "half_up": "select p_partkey, floor(p_retailprice / 7 * 100 + 0.5) / 100 rounded from part",
}
