"""Scalar functions, ranks and tails against vectors worked by hand or by exact arithmetic."""

import datetime as dt
import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions import ranks
from gleanery.functions import scalars as S
from gleanery.functions.statistics import upper_tail
from gleanery.sources import corpus


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {t}" for k, t in zip(inputs, KINDS(inputs)))) if inputs else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def KINDS(inputs):
    return [{str: "string", int: "int", float: "double", dt.date: "date", list: "array<string>", bool: "boolean", type(None): "string"}[type(v)] for v in inputs.values()]


@pytest.mark.parametrize(("n", "k", "p", "tail"), [(11, 9, 0.12, 2.25833266446e-07), (60, 31, 0.2, 4.8921095996e-08), (2000, 300, 0.1, 1.565206446e-12), (10_000, 1100, 0.1, 5.299417e-04), (60_000, 6200, 0.1, 3.430993e-03)])
def test_tails_known(n, k, p, tail):
    assert upper_tail([k], [n], [p])[0] == pytest.approx(tail, rel=1e-6)


def test_tail_guards():
    assert upper_tail([0, 1, 3, 5], [4, 4, 4, 4], [0.3, 0.0, 1.0, 0.5]).tolist() == [1, 0, 1, 0]
    assert 0 <= upper_tail([10**9], [2 * 10**9], [0.5])[0] <= 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.integers(0, 61), st.fractions(Fraction(1, 50), Fraction(49, 50), max_denominator=50))
def test_tail_is_exact(n, k, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1)) if k > 0 else Fraction(1)
    assert upper_tail([k], [n], [float(p)])[0] == pytest.approx(float(exact), rel=1e-9, abs=1e-300)


def test_texts(spark):
    one = lambda f, x: value(spark, f(F.col("t")), t=x)
    assert one(S.normalized, "That— is [inaudible] $52,329. OK?") == "that is [inaudible] $52 329 ok"
    assert [one(S.stemmed, w) for w in ("recorded", "policies", "gas", "delegations")] == ["record", "policy", "gas", "deleg"]
    assert one(S.tokens, "The [static] boiler's valve— it's -leaking- again") == ["boiler's", "valve", "it's", "leaking"]
    assert one(S.name_tokens, "callReason_code.id") == ["call", "reason", "code"]
    assert one(S.money, "about $12,500 or so") == 12500 and one(S.money, "3 k tops") == 3000 and one(S.money, "5 dollars") is None and one(S.money, "room 300") is None
    assert tuple(one(S.retraction, "52,329— no sorry, 12,329")) == (52329, 12329) and tuple(one(S.retraction, "none")) == (None, None)
    assert one(S.clean_quote, "um, the— the [inaudible] valve you know, broke .") == "the valve broke."
    assert one(S.slug, " Late Arrival: 2x! ") == "late-arrival-2x" and one(S.shortened, "x" * 61) == "x" * 60 + "…"
    assert one(S.fnv1a, "") == 2166136261 and one(S.fnv1a, "a") == 3826002220
    assert value(spark, S.window_quote(F.col("t"), F.lit("gate"), 2), t="so we saw the old gate was open all day") == "old gate was"
    assert value(spark, S.window_quote(F.col("t"), F.lit("zzz")), t="y" * 200) == "y" * 160
    assert one(S.normalized, None) is None


@pytest.mark.parametrize(("needle", "hay", "met"), [("a c", "a b c", True), ("c a", "a b c", False), ("a a", "a b", False), ("b", "b", True)])
def test_subsequence(spark, needle, hay, met):
    assert value(spark, S.is_subsequence(F.split("n", " "), F.split("h", " ")), n=needle, h=hay) is met
    assert value(spark, S.is_subsequence(F.array().cast("array<string>"), F.split("h", " ")), h=hay) is False


@pytest.mark.parametrize(
    ("text", "date"),
    [("by June 3rd", "2026-06-03"), ("tomorrow then", "2026-05-21"), ("week of the 5th", "2026-06-05"), ("Friday the 22nd", "2026-05-22"), ("on the 25th", "2026-05-25"), ("the 5th", "2026-06-05"), ("this Wednesday", "2026-05-27"), ("next Thursday", "2026-05-28"), ("someday", None)],
)
def test_spoken_dates(spark, text, date):
    got = value(spark, S.spoken_date(F.col("t"), F.col("d")), t=text, d=dt.date(2026, 5, 20))
    assert (got and str(got["date"])) == date


def test_numbers(spark):
    assert value(spark, S.half_up(F.lit(0.285))) == 0.28
    assert value(spark, S.day_of_month(F.lit(dt.date(2026, 1, 30)), F.lit(31))) == dt.date(2026, 1, 31)
    assert value(spark, S.day_of_month(F.lit(dt.date(2026, 2, 20)), F.lit(31))) == dt.date(2026, 3, 3)
    assert value(spark, S.same_number(F.lit("1,200"), F.lit("1200.004"))) is True and value(spark, S.same_number(F.lit("x"), F.lit("1"))) is False
    assert value(spark, S.absence_confidence(F.lit(0.42))) == 0.34


@pytest.mark.parametrize("parts", [1, 5])
def test_ranks(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [("hot", float(v)) for v in rng.integers(0, 30, 500)] + [("cold", 1.0)] + [(None, float(v)) for v in (4, 3, 2, 1)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    got = {r.k: (r.n, r.p50, r.p95) for r in ranks.nearest_rank(df, ["k"], "v", {"p50": (50, 100), "p95": (95, 100)}).collect()}
    at = lambda v, q: sorted(v)[min(len(v) - 1, len(v) * q // 100)]
    hot = [v for k, v in rows if k == "hot"]
    assert got == {"hot": (500, at(hot, 50), at(hot, 95)), "cold": (1, 1.0, 1.0), None: (4, 3.0, 4.0)}
    assert ranks.nearest_rank(df.where("false"), ["k"], "v", {"p": (1, 2)}).count() == 0


def test_generator_draws_and_calls(spark):
    assert [corpus.draw_at(20260817, i) for i in range(2)] == [0.9583870640490204, 0.8989665589760989]
    a, b = corpus.corpus(spark, 40).collect(), corpus.corpus(spark.newSession(), 40).repartition(3).orderBy("pos").collect()
    assert a == b and len({r.call_id for r in a}) == 40 and all(r.turns and 0.42 <= r.asr_confidence <= 0.99 for r in a)
    d = corpus.Draws(3)
    assert sorted(d.shuffled(range(9))) == list(range(9)) and all(0 <= d.below(4) < 4 for _ in range(50))
