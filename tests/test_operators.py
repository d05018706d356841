"""Operators on small tables of known result: ties, nulls, repeated rows, empty input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.operators import cells as C
from gleanery.operators import detect, discovery, evaluation, faults, funnel, grounding, mining, sampling, trace
from gleanery.sources import files
from gleanery.streaming import rollup

ROWS = "call_id string, stratum string, field string, field_ord int, value string"
FIELDS = "field string, type string, enum_values array<string>"
CALLS = "call_id string, pos int, stratum string, captured_at date, asr_confidence double"


def rows_of(spark, wide):
    return spark.createDataFrame([(f"c{i:03d}", s, f, j, v) for i, (s, r) in enumerate(wide) for j, (f, v) in enumerate(sorted(r.items())) if v is not None], ROWS)


def calls_of(spark, n, day=lambda i: i // 3):
    return spark.createDataFrame([(f"c{i:03d}", i, "s", dt.date(2024, 1, 1) + dt.timedelta(days=day(i)) if day(i) is not None else None, 0.9) for i in range(n)], CALLS)


def test_terciles_keep_ties_and_leave_few_alone(spark):
    fields = spark.createDataFrame([("a", "number", None), ("b", "number", None), ("c", "number", None), ("d", "date", None)], FIELDS)
    data = [("a", str(v)) for v in range(1, 19)] + [("b", str(v)) for v in range(17)] + [("c", "7")] * 18 + [("c", "seven")] + [("d", "2024-02-30")]
    r = spark.createDataFrame([(f"c{i:03d}", "s", f, 0, v) for i, (f, v) in enumerate(data)], ROWS)
    out = {(x.field, x.value) for x in C.bucketed(r, calls_of(spark, 80), fields).collect()}
    got = [x.value for x in C.bucketed(r, calls_of(spark, 80), fields).where("field = 'a'").orderBy("call_id").collect()]
    assert got == ["low"] * 6 + ["mid"] * 6 + ["high"] * 6
    assert {v for f, v in out if f == "b"} == {str(v) for v in range(17)} and {v for f, v in out if f == "c"} == {"seven"} and ("d", "2024-02-30") in out


def test_mirrors_taxonomy_redundancy_and_confounding(spark):
    wide = [("s", {"a": "x" if i < 10 else "y", "b": "p" if i < 10 else "q", "c": f"v{i % 2}"}) for i in range(60)]
    found, tests = mining.findings(rows_of(spark, wide), calls_of(spark, 60))
    got = {(r.cond_field, r.cond_value, r.out_field, r.out_value): r.verdict for r in found.where("family = 'association'").collect()}
    assert got == {("a", "x", "b", "p"): "redundant"}
    assert {(r.a, r.b): round(r.agreement, 3) for r in mining.redundant_columns(mining.pair_counts(rows_of(spark, wide))).collect()}["a", "b"] == 1
    assert tests.count() == 3


def test_an_effect_borrowed_from_a_stratum_is_confounded(spark):
    wide = [("s", {"a": "x" if i % 5 else "y", "b": "p" if i % 4 else "q"}) for i in range(60)] + [("t", {"a": "y" if i % 5 else "x", "b": "q" if i % 4 else "p"}) for i in range(60)]
    r = rows_of(spark, wide)
    found = spark.createDataFrame([("association", "a", "x", "b", "p")], "family string, cond_field string, cond_value string, out_field string, out_value string")
    lift = mining.stratified_lift(mining.pair_counts(r), r, found).first().stratified_lift
    assert lift == pytest.approx(1, abs=0.05)


@pytest.mark.parametrize(("days", "early"), [(lambda i: i // 3, 15), (lambda i: 0, 15), (lambda i: None if i % 2 else i, 8)])
def test_halves_split_by_rows(spark, days, early):
    h = {r.call_id: r.late for r in mining.halves(calls_of(spark, 30, days)).collect()}
    dated = [f"c{i:03d}" for i in range(30) if days(i) is not None]
    want = {} if len(dated) < 24 else {c: k >= len(dated) // 2 for k, c in enumerate(dated)}
    assert h == want


def test_adjustment_counts_all_tests_and_isnt_smoothed(spark):
    p = [0.001, 0.012, 0.011, 0.04, 0.2]
    h = spark.createDataFrame([("association", f"f{i}", "v", "g", "w", 10, 8, 0.8, 0.4, 2.0, x, 0.5) for i, x in enumerate(p)], "family string, cond_field string, cond_value string, out_field string, out_value string, n bigint, k bigint, conditional_rate double, baseline_rate double, lift double, p_value double, exclusivity double")
    assert [(r["rank"], round(r.q_value, 9)) for r in mining.adjusted(h, 20).collect()] == [(1, 0.02)]


def test_mining_of_nothing(spark):
    found, tests = mining.findings(spark.createDataFrame([], ROWS), spark.createDataFrame([], CALLS))
    assert found.count() == 0 and tests.agg(F.sum("tests")).first()[0] == 0


EV = "array<struct<quote:string,turn_index:int>>"


@pytest.mark.parametrize(
    ("value", "evidence", "want"),
    [
        ("x", [("the gate — is OPEN", 0)], {"quote_found": True, "suspicious": False, "fatal": None}),
        ("x", [("the gate is open", 1)], {"quote_found": False, "quote_found_elsewhere": True, "suspicious": True, "fatal": None}),
        ("x", [("gate open now", 0)], {"quote_found": False, "quote_is_subsequence": True, "suspicious": True, "fatal": None}),
        ("x", [("gate now open", 0)], {"fatal": "not in the call", "suspicious": True}),
        ("x", [], {"fatal": "no evidence", "has_evidence": False}),
        ("x", None, {"fatal": "no evidence"}),
        ("y", [("the gate", 0)], {"value_in_schema": False, "suspicious": True}),
        (None, [], {"absence_claim": True, "suspicious": False, "fatal": None}),
        ("x", [("", 0)], {"fatal": "not in the call"}),
        ("x", [("the gate", -1)], {"quote_found": False, "quote_found_elsewhere": True}),
        ("x", [("the gate", 99)], {"quote_found": False, "quote_found_elsewhere": True}),
    ],
)
def test_grounding(spark, value, evidence, want):
    cells = spark.createDataFrame([("c", "f", value, evidence)], f"call_id string, field string, value string, evidence {EV}")
    texts = ["the gate is open now", "fine"]
    calls = spark.createDataFrame([("c", texts, [t.split() for t in texts])], "call_id string, texts array<string>, turn_words array<array<string>>")
    got = grounding.grounded(cells, calls, spark.createDataFrame([("f", "enum", ["x"])], FIELDS)).first()
    assert {k: got[k] for k in want} == want


def test_funnel_settles_each_cell_once(spark):
    cells = [(f"c{i:03d}", f, 0.3 + (i % 7) / 10, i % 11 == 0, i % 5 == 0, "bad" if i % 13 == 0 else None) for i in range(100) for f in ("a", "b")]
    g = spark.createDataFrame(cells, "call_id string, field string, confidence double, absence_claim boolean, suspicious boolean, fatal string")
    readings = spark.createDataFrame([(c[0], c[1], int(c[0][1:]) % 3 == 0, int(c[0][1:]) % 2 == 0) for c in cells], "call_id string, field string, rejects boolean, repair_holds boolean")
    x = funnel.eligible(g, calls_of(spark, 100))
    b = funnel.budgets(x, readings)
    r = funnel.routed(x, b, readings)
    assert r.count() == len(cells) and r.where("settled is null or decided_by is null").count() == 0
    assert r.where("route = 'fatal' and settled <> 'human_review'").count() == 0 and r.where("calibration and route = 'unsampled'").count() == 0
    assert all(0.05 <= row.coverage <= 1 for row in b.collect())
    never = funnel.budgets(x.withColumn("stage", F.lit("force")), readings).first()
    assert never.rejection_rate is None and never.coverage == 1


def test_scores_are_the_documented_ratios(spark):
    # support 240, correct 162, missed 74, wrong 4, invented 0; support 109, correct 106, wrong 3, invented 60
    data = [("o", "a", "a")] * 162 + [("o", "a", None)] * 74 + [("o", "a", "b")] * 4 + [("j", "a", "a")] * 106 + [("j", "a", "b")] * 3 + [("j", None, "a")] * 60
    x = spark.createDataFrame([(f, g, p, g == p) for f, g, p in data], "field string, gold string, predicted string, right boolean")
    got = {r.field: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in evaluation.field_scores(x).collect()}
    assert got == {"o": (0.976, 0.675, 0.798), "j": (0.627, 0.972, 0.763)}


def test_routing_curve_of_known_errors(spark):
    x = spark.createDataFrame([(f"c{i}", "f", i / 100, i >= 10) for i in range(100)] + [("n", "f", None, False)], "call_id string, field string, confidence double, right boolean").repartition(5)
    got = {r.share: (r.reviewed, r.caught, r.errors) for r in evaluation.routing_curve(x).collect()}
    assert got[0.0] == (0, 0, 11) and got[0.1] == (10, 10, 11) and got[0.2] == (20, 11, 11)


def test_edges_of_bins(spark):
    x = spark.createDataFrame([(0.6, True), (0.5999999, True), (1.0, False), (0.0, True), (None, True), (7.0, True)], "confidence double, right boolean")
    assert {r.bin: r.n for r in evaluation.bins(x).collect()} == {6: 1, 5: 1, 9: 1, 0: 1}


def test_sample_has_its_size_and_strata(spark):
    calls = spark.createDataFrame([(f"c{i:03d}", i, "hot" if i > 9 else f"s{i % 3}", None, [0.95, 0.75, 0.5, None][i % 4]) for i in range(200)], CALLS)
    s = sampling.stratified(calls, 40)
    again = {r.call_id for r in sampling.stratified(calls.repartition(7), 40).collect()}
    assert s.count() == s.select("call_id").distinct().count() == 40 and {r.call_id for r in s.collect()} == again
    sizes = [r["count"] for r in sampling.sliced(s, 4).groupBy("slice").count().collect()]
    assert sizes == [10] * 4
    assert sampling.stratified(calls.limit(5), 40).count() == 5 and sampling.stratified(calls.where("false"), 40).count() == 0


def test_fault_identity_and_kinds(spark):
    fields = spark.createDataFrame([("n", "number", None), ("b", "boolean", None), ("e", "enum", ["x", "y", "z"]), ("one", "enum", ["x"])], FIELDS)
    cells = spark.createDataFrame([(f"c{i}", f, v) for i in range(300) for f, v in (("n", "1234"), ("b", "true"), ("e", "x"), ("one", "x"), ("n", None))], "call_id string, field string, value string").dropDuplicates(["call_id", "field"])
    x = faults.injected(cells, fields, 0.5)
    f = x.where("kind is not null")
    assert f.where("value is null or value <=> faulted").count() == 0 and f.where("field = 'one' and kind <> 'drop'").count() == 0
    assert f.where("field = 'n' and kind = 'digit' and (length(faulted) <> 4 or left(faulted, 1) <> '1')").count() == 0
    gold = cells.select("call_id", "field", F.col("value").alias("gold")).where("field <> 'b'")
    clean = gold.withColumn("right", F.lit(True))
    r = faults.recovery(clean, x, gold).first()
    assert r.surfaced + r.repaired == r.detectable == r.injected - r.unscored - r.already_wrong and r.lost == 0 and r.unscored > 0
    fixed = faults.recovery(clean, x, gold, cells.select("call_id", "field", "value")).first()
    assert fixed.repaired == fixed.detectable


def test_no_cluster_holds_two_of_one_proposer():
    p = [dict(proposer=i % 2, name=n, description=d, type=t, values=v, prevalence=0.6) for i, (n, d, v, t) in enumerate([("call_reason", "why the caller rang", ["a", "b", "c"], "enum"), ("reason_code", "why someone rang", ["a", "b", "d"], "enum"), ("reason_label", "why the caller rang", ["a", "c", "d"], "enum"), ("mood", "mood of the caller", ["x", "x", "y"], "string")])]
    groups = discovery.clusters(p)
    assert all(len({p[i]["proposer"] for i in g}) == len(g) for g in groups) and sorted(i for g in groups for i in g) == [0, 1, 2, 3]
    rows = discovery.settled(p, groups)
    assert [r[0] for r in rows if r[7] is None and r[4] == 2] and any(r[7] == "too few proposers" for r in rows)


def test_categories_with_runner_up(spark):
    lines = spark.createDataFrame([("d", "gate", "gate keypad barrier"), ("d", "bill", "invoice charged keypad"), ("d", "none", None)], "detector string, value string, text string")
    cues = detect.cue_table(lines)
    turns = spark.createDataFrame([("c", 0, 2, "charged for the keypad"), ("c", 1, 2, "gate barrier keypad"), ("e", 0, 1, "nothing here")], "key string, turn_index int, turns int, text string")
    (r,) = detect.best_two(detect.category_scores(turns, cues)).collect()
    assert (r.key, r.value, r.turn_index, r.runner_up) == ("c", "gate", 1, "bill") and r.margin > 0


def test_second_reading_and_repair(spark):
    cells = spark.createDataFrame([("c", "sum", "52329", [("it is 52,329", 0)]), ("c", "why", "bill", [("gate barrier", 1)]), ("e", "why", "gate", [("gate barrier", 0)]), ("f", "why", "gate", [("mumble", 0)])], f"call_id string, field string, value string, evidence {EV}")
    context = spark.createDataFrame([("c", "sum", "it is 52,329— no sorry, 12,329")], "call_id string, field string, text string")
    cues = detect.cue_table(spark.createDataFrame([("why", "gate", "gate barrier"), ("why", "bill", "invoice charged")], "detector string, value string, text string"))
    got = {(r.call_id, r.field): (r.verdict, r.corrected) for r in detect.second_readings(cells, context, cues).collect()}
    assert got == {("c", "sum"): ("reject", "12329.0"), ("c", "why"): ("reject", "gate"), ("e", "why"): ("accept", "gate"), ("f", "why"): ("reject", None)}
    fixed = {(r.call_id, r.field): (r.value, r.confidence, r.outcome) for r in detect.repaired(cells, detect.second_readings(cells, context, cues)).collect()}
    assert fixed["f", "why"] == (None, 0.3, "human_review") and fixed["c", "why"] == ("gate", 0.66, "repaired")


def test_costs(spark):
    s = spark.createDataFrame([("m", 1_000_000, 1_000_000, 0, 0), ("m", 0, 0, 1_000_000, 0), ("m", 0, 0, 0, 1_000_000), ("unknown", 1_000_000, 0, 0, None)], "model string, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint")
    prices = spark.createDataFrame([("m", 5.0, 25.0), ("n", 1.0, 5.0)], "model string, input_price double, output_price double")
    assert sorted(r.cost for r in trace.token_cost(s, prices).collect()) == [0.5, 5.0, 6.25, 30.0]


def test_sinks_and_views(spark, tmp_path):
    calls = spark.createDataFrame([(f"c{i}", i, [(65, "AGENT", "hello")]) for i in range(9)], "call_id string, pos int, turns array<struct<t:int,speaker:string,text:string>>")
    assert files.rendered(calls, 2).collect()[1].text == "[1:05] AGENT: hello"
    paths = files.write_tables(str(tmp_path), {"calls": calls}, "json")
    assert spark.read.json(paths["calls"]).count() == 9
    assert files.as_json(calls).first().json.startswith('{"call_id":"c') and files.summary(calls, "pos").agg(F.sum("share")).first()[0] == pytest.approx(1)
    assert calls.select(files.highlighted(F.lit("a gate b"), F.lit("gate")).alias("x")).first().x == "a **gate** b"


def test_streams_take_late_and_repeated_rows(spark, tmp_path):
    ddl = "id string, agent string, ok boolean, input_tokens bigint, output_tokens bigint, received_at timestamp"
    t = dt.datetime(2024, 1, 1, 12)
    for i, rows in enumerate([[("a", " X", True, 1, 1, t), ("b", "x", False, 1, 1, t)], [("a", "x", True, 1, 1, t + dt.timedelta(minutes=1)), ("c", "x", True, 1, 1, t - dt.timedelta(hours=3))]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{tmp_path}/s/{i}")
    stream = rollup.read_stream(spark, f"{tmp_path}/s/*") if False else spark.readStream.schema(ddl).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
    (r,) = rollup.settled(rollup.span_windows(stream), ["window", "agent"], f"{tmp_path}/state").collect()
    assert (r.agent, r.calls, r.failures) == ("x", 3, 1)
