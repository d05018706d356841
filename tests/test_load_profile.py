"""Problem 2 on small tables of known result, and its classifier on planted changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import load_profile as lp

CELLS = "load_no int, field string, call_id string, value string, confidence double, disposition string, n int, extra string"
FIELDS = "field string, type string, enum_values array<string>"


def cells(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CELLS)


def issues(df):
    return {(r.load_no, r.field, i) for r in df.collect() for i in r.issues}


def test_departing_loads(spark):
    rows = [(n, "sum", f"c{i}", "1.5" if n != 2 or i % 2 else ("1,5" if i else None), 0.8 if n != 1 else 0.5, "accepted" if n != 0 or i > 3 else "Accepted") for n in range(3) for i in range(10)]
    rows += [(2, "sum", "c", None, 7.0, None)] * 3
    got = issues(lp.load_profile(cells(spark, rows), spark.createDataFrame([("sum", "number", None)], FIELDS)))
    assert got == {(0, "sum", "disposition_label"), (0, "sum", "disposition_shift"), (1, "sum", "confidence_shift"), (1, "sum", "disposition_shift"), (2, "sum", "confidence_range"), (2, "sum", "null_rate"), (2, "sum", "value_pattern")}


def test_classifier_names_the_changed_column(spark):
    rng = np.random.default_rng(1)
    rows = [
        (n, "mood", f"c{n}_{i}", None if rng.random() < (0.5 if n == 1 else 0.1) else "good", float(rng.random() * (0.5 if n == 2 else 1)), "repaired" if rng.random() < (0.6 if n == 3 else 0.2) else "accepted")
        for n in range(6)
        for i in range(400)
    ]
    p = {r.load_no: r for r in lp.load_profile(cells(spark, rows), spark.createDataFrame([("mood", "enum", ["good"])], FIELDS)).collect()}
    for load, column in ((1, "value"), (2, "confidence"), (3, "disposition")):
        assert column in p[load].nominated and p[load].auc > 0.6
        assert p[load][f"lost_without_{column}"] == max(p[load][f"lost_without_{c}"] for c in lp.COLUMNS) > 0.05
    assert abs(p[0].auc - 0.5) < 0.12 and abs(p[5].auc - 0.5) < 0.12
    assert p[1].issues == ["null_rate"] and p[3].issues == ["disposition_shift"] and p[0].issues == []


def test_nulls_empty_and_unknown_fields(spark):
    rows = [(None, None, None, None, None, None)] * 40 + [(1, None, "a", "v" * 100_000, float("nan"), "")] * 40
    got = lp.load_profile(cells(spark, rows), spark.createDataFrame([], FIELDS)).collect()
    assert {(r.load_no, r.n, r.n_value, r.distinct_values) for r in got} == {(None, 40, 0, 0), (1, 40, 40, 1)}
    assert lp.load_profile(cells(spark, []), spark.createDataFrame([("a", "enum", None)], FIELDS)).count() == 0


@pytest.mark.parametrize("n", [5, 800])
def test_area_is_the_share_of_ordered_pairs(n):
    rng = np.random.default_rng(n)
    s, n1, n0 = np.round(rng.random(n), 1), rng.integers(0, 5, n).astype(float), rng.integers(0, 5, n).astype(float)
    less, same = s[:, None] > s[None, :], s[:, None] == s[None, :]
    assert lp.area(s, n1, n0) == pytest.approx(((less + same / 2) * n1[:, None] * n0[None, :]).sum() / n1.sum() / n0.sum())


def test_every_exact_departure_is_nominated(spark):
    from gleanery.plans import registry

    p = registry.queries()["p2_profile"](spark, "/root/testdata/sf0.01")
    off = p.where("null_off > 0.23 or confidence_off > 0.15 or label_off > 0.23")
    assert off.where(F.expr("(null_off > 0.23 and not array_contains(nominated, 'value')) or (confidence_off > 0.15 and not array_contains(nominated, 'confidence')) or (label_off > 0.23 and not array_contains(nominated, 'disposition'))")).count() == 0 < off.count()
