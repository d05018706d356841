"""Problem 4: personal data in turn texts, each item with its place, and the texts with typed placeholders.

The records of a call are stripped of stamps, labels, sounds and fillers by the tagger of problem 6, and what is left is
labelled by a skip-chain conditional random field: a chain per record, and links between the tokens of the call
that are the same or similar, which share a potential over kinds of entity. Loopy message passing over chains and links
gives the beliefs, Viterbi along the chains the labels. Each token links to the next of its kind only, so the work
is linear in the call. The model is trained on invented talk (talk.py, train.py) with invented names; no list of names is used.

Offsets count characters of the raw text. A call delivered twice counts as first delivered; records keep their place as
delivered, null ones included, and a repeated record has its items under each of its places. Null or empty texts have no items.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gleanery.common import table

from . import crf
from .turns import chunks, first_delivered, tagged

MODEL = "items"
#: Digits as words.
SPOKEN_DIGITS = set("zero oh one two three four five six seven eight nine double triple".split())
#: House numbers as words begin with one of these.
NUMBERS = set("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety".split())


def plausible(kind: str, text: str) -> bool:
    """The exact check behind the model: an item must have what makes its kind, so much that a masked text stays readable."""
    digits = sum(c.isdigit() for c in text)
    if kind == "phone":
        return digits >= 7 or digits + sum(w in SPOKEN_DIGITS for w in re.findall("[a-z]+", text.lower())) >= 5
    if kind == "id_number":
        return digits >= 6
    if kind == "email":
        return "@" in text or bool(re.search(r"\bat\b|\bdot\b", text, re.I))
    if kind == "address":
        first = re.match(r"\w+", text)[0].lower()
        return first[0].isdigit() or first in NUMBERS
    return any(c.isalpha() for c in text)


def label_spans(labels: list[str], y, text_of) -> list[tuple[str, int, int]]:
    """(kind, first token, last token) of labels with a beginning or inside mark; an inside without a beginning begins one."""
    out: list[list] = []
    open_ = False
    for j, label in enumerate(y):
        mark, _, kind = labels[label].partition("-")
        if mark == "I" and open_ and out[-1][0] == kind and text_of[j] == text_of[j - 1]:
            out[-1][2] = j
        elif mark != "O":
            out.append([kind, j, j])
        open_ = mark != "O"
    return [tuple(x) for x in out]


def items(texts: list[str], documents: list[int]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) of every raw text; documents says which texts are of one call."""
    parts = tagged(texts, documents)
    model = crf.load(MODEL)
    batch = crf.Batch([p.text for p in parts], documents)
    out: list[list] = [[] for _ in texts]
    if not len(batch.start):
        return out
    _, _, unary = model.beliefs(model.emissions(batch.features()), batch, crf.skip_links(batch, model.common))
    y = model.viterbi(unary, batch)
    for kind, first, last in label_spans(model.labels, y.tolist(), batch.text_of.tolist()):
        i = int(batch.text_of[first])
        text, at = parts[i].text, parts[i].at
        s, e = int(batch.start[first]), int(batch.end[last])
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not (text[e - 1].isalnum() or text[e - 1] == ")"):
            e -= 1
        if s < e and plausible(kind, text[s:e]):
            out[i].append((kind, at[s], at[e - 1] + 1))
    return out


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    for kind, start, end in sorted(found, key=lambda x: -x[1]):
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def _of_calls(batches):
    for b in batches:
        for rows in chunks(b.to_pylist()):
            places = [(r["call_id"], i, u["text"]) for r in rows for i, u in enumerate(r["turns"] or []) if u and u["text"]]
            documents = {}
            of = [documents.setdefault(id(r), len(documents)) for r in rows for u in (r["turns"] or []) if u and u["text"]]
            yield places, items([x for _, _, x in places], of)


def _found(batches):
    import pyarrow as pa

    for places, found in _of_calls(batches):
        rows = [(c, i, kind, start) for (c, i, _), xs in zip(places, found) for kind, start, _ in xs]
        call, turn, kind, start = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(call, pa.string()), pa.array(turn, pa.int32()), pa.array(kind, pa.string()), pa.array(start, pa.int32())], names=["call_id", "turn_index", "kind", "start_at"])


def _masked(batches):
    import pyarrow as pa

    for places, found in _of_calls(batches):
        rows = [(c, i, masked(x, f), len(f)) for (c, i, x), f in zip(places, found)]
        call, turn, text, n = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(call, pa.string()), pa.array(turn, pa.int32()), pa.array(text, pa.string()), pa.array(n, pa.int32())], names=["call_id", "turn_index", "text", "items"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = first_delivered(table(spark, sf_dir, "transcripts")).select("call_id", "turns")
    return calls.mapInArrow(_found, "call_id string, turn_index int, kind string, start_at int")


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, turn_index, text, items): every record with typed placeholders."""
    calls = first_delivered(table(spark, sf_dir, "transcripts")).select("call_id", "turns")
    return calls.mapInArrow(_masked, "call_id string, turn_index int, text string, items int")


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
