"""Problems 4 and 6: the taggers on held-out talk, assembly on small calls, and the queries' edge cases."""

import numpy as np
import pytest

from gleanery.llm import crf, pii, talk, train, turns

TURN = "array<struct<t:int,speaker:string,text:string>>"
DDL = f"call_id string, turns {TURN}, duration_sec int, ingested_at timestamp, text string"


def test_tagger_on_held_out_talk():
    hit = all_ = 0
    model = crf.load("tags")
    for batch, y in train.tag_batches(99, 120):
        got = model.viterbi(model.emissions(batch.features()), batch)
        hit, all_ = hit + (got == y).sum(), all_ + len(y)
    assert hit / all_ > 0.99


def test_items_on_held_out_talk_and_links_help():
    model, by = crf.load("items"), {}
    for links in (True, False):
        found, true = [], []
        for batch, y in train.item_batches(98, 240):
            link = crf.skip_links(batch, model.common) if links else np.zeros((0, 2), np.int64)
            _, _, unary = model.beliefs(model.emissions(batch.features()), batch, link)
            found.append(train.spans(model.viterbi(unary, batch), batch))
            true.append(train.spans(y, batch))
        by[links] = train.scores(found, true)
    assert all(p > 0.9 and r > 0.9 for p, r in by[True].values())
    assert by[True]["name"][1] > by[False]["name"][1]


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    f = crf.Field(["O", "B-a", "B-b"], transitions=rng.normal(size=(3, 3)), skip=rng.normal(size=(3, 3)))
    f.skip = f.skip + f.skip.T
    batch = crf.Batch(["x Aaaaa", "Aaaaa y"], [0, 0])
    links, e = crf.skip_links(batch, set()), rng.normal(size=(4, 3))
    assert links.tolist() == [[1, 2]]
    b, _, _ = f.beliefs(e, batch, links, rounds=4)
    joint = np.zeros((3,) * 4)
    for y in np.ndindex(joint.shape):
        joint[y] = np.exp(sum(e[i, y[i]] for i in range(4)) + f.transitions[y[0], y[1]] + f.transitions[y[2], y[3]] + f.skip[f.kind_of[y[1]], f.kind_of[y[2]]])
    joint /= joint.sum()
    for i in range(4):
        assert b[i] == pytest.approx(joint.sum(axis=tuple(j for j in range(4) if j != i)), abs=1e-6)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    f = crf.Field(["a", "b", "c"], transitions=rng.normal(size=(3, 3)))
    batch = crf.Batch(["p q r s"])
    e = rng.normal(size=(4, 3))
    best = max(np.ndindex((3,) * 4), key=lambda y: sum(e[i, y[i]] for i in range(4)) + sum(f.transitions[y[i], y[i + 1]] for i in range(3)))
    assert tuple(f.viterbi(e, batch)) == best


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("so that's Brenthwick, Olvar, olv02@lists.quern.example, and the ID 984-34-1028.", [("name", "Brenthwick"), ("email", "olv02"), ("id_number", "984")]),
        ("[00:14] (coughs) call me on (733) 555-0144 or at work, +44 1632 960609", [("phone", "733"), ("phone", "44")]),
        ("deliver to 585 Tarnwell Ave, Eastholm 66325, round the back.", [("address", "585")]),
        ("my email is olvar underscore fennick at quern dash office dot test", [("email", "olvar")]),
        ("best number is five five five oh one uh, oh seven.", [("phone", "five")]),
        ("it's under Dr. O'Terrick, that's the account holder", [("name", "O'Terrick")]),
        ("you're through to Olvar <noise> G. Brenthwick on the service desk", [("name", "Olvar")]),
        ("the hazel wood trim has gone green", []),
        ("we post that on the board as @harbour_desk every Friday", []),
        ("the part number is 711-9708, it's order 4471-882, tracking is 1Z700763065", []),
        ("I'm at the Tarnwell depot, by the Anchor cafe", []),
        ("", []),
        ("— … ?", []),
    ],
)
def test_p4_items(text, expected):
    (found,) = pii.items([text], [0])
    assert [(k, text[s:e][: len(x)]) for (k, s, e), (_, x) in zip(sorted(found, key=lambda f: f[1]), expected)] == expected and len(found) == len(expected)


def test_p4_queries(spark, tmp_path):
    said = [(1, "A", "call me on 212-555-0144 please"), (2, None, None), None, (3, "B", "my email is olv@quern.example"), (3, "B", "my email is olv@quern.example")]
    day = __import__("datetime").datetime
    rows = [("a", said, 9, day(2024, 1, 1), "x"), ("a", said, 9, day(2024, 1, 2), None), ("b", None, None, None, None), ("c", [], 1, day(2024, 1, 1), ""), (None, [(1, "A", "right")], None, None, "")]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/transcripts.parquet")
    assert sorted(tuple(r) for r in pii.p4_found(spark, str(tmp_path)).collect()) == [("a", 0, "phone", 11), ("a", 3, "email", 12), ("a", 4, "email", 12)]
    texts = {(r.call_id, r.turn_index): r.text for r in pii.p4_masked(spark, str(tmp_path)).collect()}
    assert texts["a", 0] == "call me on [PHONE] please" and texts["a", 3] == "my email is [EMAIL]" and texts[None, 0] == "right"
    got = [tuple(r) for r in turns.p6_found(spark, str(tmp_path)).orderBy("call_id", "turn_no").collect()]
    assert got == [(None, 0, "AGENT", 1, 1)] or got[0][0] is None and got[1:] == [("a", 0, "UNKNOWN", 1, 9)]


def test_p4_long_text_and_offsets_beyond_the_basic_plane():
    text = "𝔘 ring me back on 212-555-0144 " + "so it goes on and on " * 4000 + "call me on 212-555-0199"
    (found,) = pii.items([text], [0])
    assert [text[s : s + 12] for k, s, _ in found if k == "phone"] == ["212-555-0144", "212-555-0199"]


def test_p6_clean_turns():
    raw = [
        {"t": 9000, "speaker": "AGENT", "text": "Agent: past, sort of, the uh... lift"},
        {"t": 2000, "speaker": None, "text": "<0m02s> >> Cust: the sort of rope (the grey one)"},
        {"t": 2000, "speaker": None, "text": "<0m02s> >> Cust: the sort of rope (the grey one)"},
        {"t": 5000, "speaker": "?", "text": "[INAUDIBLE 0:03] um,"},
        {"t": 7000, "speaker": " Customer", "text": "hmm, at 16:45 (0:07) today"},
        {"t": 95000, "speaker": "spk", "text": "okay"},
    ]
    (got,) = turns.clean_turns([(raw, 99)])
    assert [(x["turn_no"], x["speaker"], x["start_sec"], x["n_words"]) for x in got] == [(0, "CUSTOMER", 2, 10), (1, "AGENT", 9, 3), (2, "UNKNOWN", 95, 1)]


def test_p6_stamps_where_t_is_missing():
    raw = [{"t": None, "speaker": "Rep", "text": "00:01:05 - second thing"}, {"t": None, "speaker": "caller (mobile)", "text": "00:00:07 - first"}, {"t": None, "speaker": "", "text": "and more"}, {"t": None, "speaker": None, "text": None}]
    (got,) = turns.clean_turns([(raw, None)])
    assert [(x["speaker"], x["start_sec"], x["text"]) for x in got] == [("CUSTOMER", 7, "first"), ("UNKNOWN", 7, "and more"), ("AGENT", 65, "second thing")]


@pytest.mark.parametrize(("raw", "who"), [("Agent 2", "AGENT"), ("caller (mobile)", "CUSTOMER"), ("cust.", "CUSTOMER"), (">> Service Rep:", "AGENT"), ("Speaker 1", "UNKNOWN"), ("?", "UNKNOWN"), (None, "UNKNOWN"), ("System", "IVR")])
def test_p6_speakers(raw, who):
    assert turns.folded_speaker(raw) == who
