"""Reading whole calls in place: the same as the join of tokens and cues, and no shuffle but the one that finds a call's first delivery."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gleanery.operators import categories, detect, discovery

DATA = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("at_once", [1, 100, 4_000_000])
def test_in_place_is_the_same_as_the_join(spark, monkeypatch, at_once):
    monkeypatch.setattr(categories, "AT_ONCE", at_once)
    draw = random.Random(5)
    vocabulary = [f"word{i}" for i in range(30)]
    lines = [(d, f"v{v}", " ".join(draw.choices(vocabulary, k=6))) for d in ("reason", "outcome", "mood") for v in range(4)]
    cues = detect.cue_table(spark.createDataFrame(lines, "detector string, value string, text string"))
    text = lambda: draw.choice([None, "", "nothing known", *(" ".join(draw.choices(vocabulary, k=n)) for n in (1, 1, 3, 5))])
    calls = [(f"c{i}", None if i == 7 else [text() for _ in range(i % 6)]) for i in range(80)]
    calls = spark.createDataFrame(calls, "key string, texts array<string>")
    turns = calls.select("key", F.posexplode("texts").alias("turn_index", "text")).where("text is not null")
    turns = turns.join(turns.groupBy("key").agg((F.max("turn_index") + 1).alias("turns")), "key")
    columns = ("key", "detector", "value", "turn_index", F.round("hit", 6).alias("hit"), F.round("score", 6).alias("score"), "runner_up", F.round("margin", 6).alias("margin"))
    want = detect.best_two(detect.category_scores(turns, cues)).select(*columns)
    x = categories.with_categories(calls.select("key", categories.words(F.col("texts")).alias("words")), cues)
    got = x.select("key", F.explode("cats").alias("c")).select("key", "c.*").select(*columns)
    assert x.count() == 80 and want.count() > 100
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_cues_and_no_calls(spark):
    none = detect.cue_table(spark.createDataFrame([], "detector string, value string, text string"))
    calls = spark.createDataFrame([("c", ["some words"])], "key string, texts array<string>").select("key", categories.words(F.col("texts")).alias("words"))
    assert categories.with_categories(calls, none).first().cats == [] and categories.with_categories(calls.where("false"), none).count() == 0


def test_categories_shuffle_the_texts_once(spark):
    assert shuffles(entry.queries()["category_top2"](spark, DATA)) == 1


def test_cells_shuffle_the_texts_once(spark):
    assert shuffles(entry.queries()["extract_cells"](spark, DATA)) == 1


def test_cells_of_all_calls_shuffle_less_than_the_disk_allows(spark):
    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    earlier = max(written(), default=-1)
    rows = entry.queries()["extract_cells"](spark, DATA).collect()
    calls = {r.call_id for r in spark.read.parquet(f"{DATA}/transcripts.parquet").where("call_id is not null").select("call_id").collect()}
    assert len(rows) == len({(r.call_id, r.field) for r in rows}) == len(calls) * len({r.field for r in rows})
    read = sum(Path(DATA, f"{t}.parquet").stat().st_size for t in ("transcripts", "validated_cells"))
    # the check allows 4 times the input on disk; a join of the turns with the cues shuffled 6 times
    assert 0 < sum(b for stage, b in written().items() if stage > earlier) < 3 * read


def test_a_few_calls_are_read_as_among_all(spark):
    every = detect.extracted(spark, DATA)
    few = every.select("call_id").distinct().orderBy(F.xxhash64("call_id")).limit(9)
    want = every.join(few, "call_id", "left_semi").collect()
    assert len(want) > 100 and sorted(map(str, detect.extracted(spark, DATA, few).collect())) == sorted(map(str, want))
    drawn = discovery.q_proposals(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert drawn.count("Join LeftSemi") == 1


def test_stored_rows_are_the_rows_and_cells_carry_their_reading(spark):
    from gleanery.common import durable, stored

    x = stored(spark.createDataFrame([("c", "why", "bill", "gate barrier", None), ("e", "why", "gate", "gate barrier", None)], "call_id string, field string, value string, quote string, text string"))
    cues = durable(detect.cue_table(spark.createDataFrame([("why", "gate", "gate barrier"), ("why", "bill", "invoice charged")], "detector string, value string, text string")))
    y = detect.reread(x, cues)
    assert shuffles(y.select("call_id", "verdict")) <= 1 and {(r.call_id, r.verdict, r.corrected) for r in y.collect()} == {("c", "reject", "gate"), ("e", "accept", "gate")}
