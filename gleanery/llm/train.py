"""python -m gleanery.llm.train [tags] [items]: trains the taggers of problems 6 and 4 on invented talk and writes gleanery/llm/models.

Prints precision and recall on held-out talk (other names, addresses and noise, from another seed).
"""

import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np

from . import crf, talk

LABELS = ["O", *(f"{p}-{k}" for k in talk.KINDS for p in "BI")]
CALLS, PER_BATCH = 4_000, 60


def tag_batches(seed: int, calls: int, personal: float = 0.3):
    t = talk.Talk(seed)
    for _ in range(calls // PER_BATCH):
        texts, documents, labels = [], [], []
        for d in range(PER_BATCH):
            for record in t.call(t.r.randint(4, 16), personal):
                text, tags, _ = talk.labelled(record)
                texts.append(text)
                documents.append(d)
                labels.append(tags)
        batch = crf.Batch(texts, documents)
        y = np.zeros(len(batch.start), np.int64)
        for i, tags in enumerate(labels):
            at = slice(batch.first[i], batch.first[i + 1])
            ends = np.array([e for _, e, _ in tags] or [0])
            which = np.searchsorted(ends, batch.start[at], side="right")
            y[at] = [talk.TAGS.index(tags[w][2]) for w in which]
        yield batch, y


def spoken(record: list) -> tuple[str, list[tuple[int, int, str]]]:
    """The record as problem 4 sees it: speech alone, noise left out."""
    kept = [(t if t[0] == " " or not i else t, tag, kind) for i, (t, tag, kind) in enumerate(record) if tag == "speech"]
    text, _, items = talk.labelled(kept)
    shift = len(text) - len(text.lstrip())
    return text.strip(), [(max(0, a - shift), b - shift, k) for a, b, k in items]


def item_batches(seed: int, calls: int, personal: float = 0.45):
    t = talk.Talk(seed)
    for _ in range(calls // PER_BATCH):
        texts, documents, items = [], [], []
        for d in range(PER_BATCH):
            for record in t.call(t.r.randint(4, 16), personal):
                text, spans = spoken(record)
                texts.append(text)
                documents.append(d)
                items.append(spans)
        batch = crf.Batch(texts, documents)
        y = np.zeros(len(batch.start), np.int64)
        for i, spans in enumerate(items):
            for a, b, k in spans:
                inside = [j for j in range(batch.first[i], batch.first[i + 1]) if a <= batch.start[j] < b]
                for n, j in enumerate(inside):
                    y[j] = LABELS.index(("B-" if n == 0 else "I-") + k)
        yield batch, y


def spans(y: np.ndarray, batch: crf.Batch) -> set[tuple]:
    out, current = [], None
    for j, label in enumerate(y):
        name = LABELS[label]
        if name[0] == "B" or (name[0] == "I" and (current is None or current[0] != name[2:] or batch.text_of[j] != batch.text_of[j - 1])):
            current = [name[2:], j, j]
            out.append(current)
        elif name[0] == "I":
            current[2] = j
        else:
            current = None
    return {tuple(x) for x in out}


def scores(found: list[set], true: list[set]) -> dict[str, tuple[float, float]]:
    hit, got, want = Counter(), Counter(), Counter()
    for f, t in zip(found, true):
        hit.update(k for k, *_ in f & t)
        got.update(k for k, *_ in f)
        want.update(k for k, *_ in t)
    return {k: (hit[k] / max(got[k], 1), hit[k] / max(want[k], 1)) for k in sorted(want)}


def train_tags() -> crf.Field:
    model = crf.Field(talk.TAGS).train(list(tag_batches(11, CALLS)))
    hit = Counter()
    for batch, y in tag_batches(12, 480):
        got = model.viterbi(model.emissions(batch.features()), batch)
        for a, b in zip(got, y):
            hit[talk.TAGS[b], talk.TAGS[a]] += 1
    for t in talk.TAGS:
        right = hit[t, t]
        print(f"{t}: precision {right / max(1, sum(n for (_, g), n in hit.items() if g == t)):.4f}, recall {right / max(1, sum(n for (w, _), n in hit.items() if w == t)):.4f}")
    return model


def train_items() -> crf.Field:
    batches = list(item_batches(21, CALLS))
    plain = Counter(w.lower() for b, y in batches for w, label in zip(b.words, y) if label == 0)
    model = crf.Field(LABELS, common=[w for w, n in plain.items() if n >= 20 and w.isalpha()])
    model.train(batches, epochs=5, with_links=True)
    for links in (True, False):
        found, true = [], []
        for batch, y in item_batches(22, 480):
            link = crf.skip_links(batch, model.common) if links else np.zeros((0, 2), np.int64)
            _, _, unary = model.beliefs(model.emissions(batch.features()), batch, link)
            found.append(spans(model.viterbi(unary, batch), batch))
            true.append(spans(y, batch))
        print("with links" if links else "chains alone", {k: f"{p:.3f} {r:.3f}" for k, (p, r) in scores(found, true).items()})
    print("links between kinds", sorted(set(x.split("-")[-1] for x in LABELS)), model.skip.round(2).tolist())
    return model


if __name__ == "__main__":
    for name, train in (("tags", train_tags), ("items", train_items)):
        if name in sys.argv[1:] or len(sys.argv) == 1:
            began = time.time()
            data = train().saved()
            Path(__file__).parent.joinpath("models", f"{name}.npz").write_bytes(data)
            print(name, len(data), "bytes", round(time.time() - began), "s")
