"""Problems 1, 3 and 5: frequencies, co-occurrence and percentiles against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from gleanery.llm import cooccurrence, lexicon, percentiles


def write(spark, folder, **tables):
    for t, (ddl, rows) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return str(folder)


GOLD, NOTES = "call_id string, reason string, objection string, mark string", "call_id string, field string, value string, term string"


def test_p1_marks(spark, tmp_path):
    gold = [(f"c{i}", " Billing " if i < 5 else f"r{i // 3}", None if i else " ", "z") for i in range(14)] + [("c13", "r4", None, None)]
    cells = [(f"c{i}", "issue_note", "lens Lens lost" if i < 2 else f"w{i // 3} x", None) for i in range(14)] + [("c1", "issue_note", "LENS lens lost", "y"), ("c2", "reason", "zzz", None)]
    d = write(spark, tmp_path, gold=(GOLD, gold), validated_cells=(NOTES, cells))
    assert {tuple(r) for r in lexicon.p1_found(spark, d).collect()} == {
        ("reason", "billing", "common"), ("reason", "r1", "rare"), ("reason", "r4", "rare"), ("value", "lens", "rare"),
        ("value", "lost", "rare"), ("value", "x", "common"), ("value", "w0", "rare"), ("value", "w4", "rare"),
    }
    n = {(r.field_name, r.term): (r.occurrences, r.calls, r.field_calls) for r in lexicon.p1_terms(spark, d).collect()}
    assert n["value", "lens"] == (4, 2, 14) and n["reason", "billing"] == (5, 5, 14)


def test_p1_empty_nulls_and_long(spark, tmp_path):
    d = write(spark, tmp_path, gold=(GOLD, []), validated_cells=(NOTES, [(None, "issue_note", "w " * 50_000, None), ("a", None, None, None), ("b", "issue_note", "—", None)]))
    # a null call is no call, but its record is counted
    assert {(r.term, r.occurrences, r.calls) for r in lexicon.p1_terms(spark, d).collect()} == {("w", 50_000, 0)}


@pytest.mark.parametrize("share", [0.0, 1 / 64, 0.2, 2.0])
def test_p3_any_threshold_gives_the_same_pairs(spark, share):
    rng = np.random.default_rng(7)
    rows = [(f"b{i}", f"f{f}", f"v{min(int(rng.zipf(1.4)), 40)}") for i in range(300) for f in range(5) if rng.random() < 0.7]
    rows += rows[:50] + [(None, "f0", "v1"), ("b1", None, "v1"), ("b1", "f1", None)]
    by = {}
    for b, f, v in rows:
        if None not in (b, f, v):
            by.setdefault(b, set()).add((f, v))
    n = Counter(x for s in by.values() for x in s)
    expected = Counter(p for s in by.values() for p in combinations(sorted(s), 2) if p[0][0] != p[1][0])
    df = spark.createDataFrame(rows, "basket string, field string, item string").withColumn("heavy", pd_lit("x"))
    got = {((r.field_a, r.item_a), (r.field_b, r.item_b)): r for r in cooccurrence.pairs(df, 300, share, block=64).collect()}
    assert {k: r.shared for k, r in got.items()} == dict(expected)
    assert all(abs(r.lift - r.shared * 300 / (n[a] * n[b])) < 1e-9 for (a, b), r in got.items())


def pd_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def test_p3_one_basket_with_a_third_of_all_rows_and_empty(spark):
    rows = [("hot", "f", f"v{i}") for i in range(100)] * 5 + [("hot", "g", "w")] + [(f"b{i}", "f", "v1") for i in range(1000)]
    df = spark.createDataFrame(rows, "basket string, field string, item string")
    assert {(r.item_a, r.item_b, r.shared) for r in cooccurrence.pairs(df, 1001, block=64).collect()} == {(f"v{i}", "w", 1) for i in range(100)}
    assert cooccurrence.pairs(df.where("false"), 0).count() == 0


def test_p3_found(spark, tmp_path):
    cells = [(f"c{i}", f, v, "accepted") for i in range(30) for f, v in (("a", " X" if i < 6 else "y"), ("b", "P" if i < 6 else "q"))]
    cells += cells[:4] + [(f"c{i}", "b", "P", "Accepted") for i in range(6, 20)]
    fields = [("a", "enum", ["x", "y"]), ("b", "enum", ["p", "q"])]
    d = write(spark, tmp_path, validated_cells=("call_id string, field string, value string, disposition string", cells), schema_fields=("field string, type string, enum_values array<string>", fields))
    assert {tuple(r) for r in cooccurrence.p3_found(spark, d).collect()} == {("a=x", "b=p")}


ORDERS = {
    "random": lambda n: np.random.default_rng(3).lognormal(6, 2, n),
    "sorted": lambda n: np.arange(n, dtype=float),
    "reversed": lambda n: np.arange(n, dtype=float)[::-1],
    "ties": lambda n: np.repeat([1.0, 2.0, 3.0], n)[: 3 * n : 3],
    "zigzag": lambda n: np.where(np.arange(n) % 2, np.arange(n), -np.arange(n)).astype(float),
}


@pytest.mark.parametrize("order", ORDERS)
def test_p5_rank_error_stays_within_the_stated_bound(order):
    values, k = ORDERS[order](1_000_000), 128
    parts = [percentiles.Sketch(k).add(v) for v in np.array_split(values, 13)]
    whole = percentiles.Sketch(k)
    for p in parts:
        whole.merge(p.buffers(), p.n, p.error)
    assert whole.n == len(values) and max(len(b) for _, b in whole.buffers()) <= k
    assert whole.error < 0.06 * whole.n
    ordered = np.sort(values)
    for q in (0.01, 0.5, 0.95, 0.999):
        est, low, high = percentiles.bracket(whole.buffers(), whole.n, whole.error, q)
        true = ordered[percentiles.place(len(values), q)]
        assert low <= true <= high and low <= est <= high
        below, upto = np.searchsorted(ordered, est, "left"), np.searchsorted(ordered, est, "right")
        assert below - whole.error <= q * len(values) <= upto + whole.error


def test_p5_sketches_join_over_keys(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"run": rng.integers(0, 3, 30_000).astype(str), "agent": np.where(rng.random(30_000) < 0.8, "hot", "cold"), "v": rng.exponential(100, 30_000)})
    pdf.loc[:50, "agent"], pdf.loc[100:120, "v"] = None, np.nan
    df = spark.createDataFrame(pdf).selectExpr("run", "agent", "nullif(v, double('nan')) v", "1 as n", "2 as level").repartition(6)
    fine = percentiles.merge(percentiles.build(df, ["run", "agent"], "v", 64), ["run", "agent"], 64)
    for r in percentiles.estimates(percentiles.merge(fine, ["agent"], 64), ["agent"]).collect():
        of = pdf[pdf["agent"].isna() if r.agent is None else pdf["agent"] == r.agent]["v"].dropna().sort_values().to_numpy()
        assert r.n == len(of) and r.low <= of[percentiles.place(r.n, r.q)] <= r.high
    assert percentiles.estimates(percentiles.merge(percentiles.build(df.where("false"), ["run"], "v"), ["run"]), ["run"]).count() == 0


def test_p5_exact_value_within_a_wide_bracket(spark):
    values = [float(i * i % 1009) for i in range(3000)]
    df = spark.createDataFrame([("r", v) for v in values], "run string, v double").repartition(3)
    est = percentiles.estimates(percentiles.merge(percentiles.build(df, ["run"], "v", 32), ["run"], 32), ["run"])
    assert est.where("error > 0 and low < high").count() == 2
    exact = {r.q: r.exact for r in percentiles.exact_at(df, est, ["run"], "v").collect()}
    assert exact == {q: sorted(values)[percentiles.place(3000, q)] for q in (0.5, 0.95)}


def test_p5_against_the_true_place(spark, tmp_path):
    spans = [(f"s{i}", "r", " Extract" if i % 2 else "extract", 10 * (i + 1)) for i in range(20)]
    spans += spans[:9] + [("x", "r", "extract", None), ("y", "r", "extract", -5)]
    for p50, cases in ((110.0, set()), (130.0, {("r", "extract")}), (None, set())):
        d = write(spark, tmp_path, spans=("id string, run_id string, agent string, duration_ms bigint", spans), agent_rollup=("run_id string, agent string, p50_ms double, p95_ms double", [("r", "extract", p50, 200.0), ("q", "extract", 1.0, 1.0)]))
        assert {tuple(r) for r in percentiles.p5_found(spark, d).collect()} == cases
