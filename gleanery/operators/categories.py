"""The best category and the next per row and detector, computed in place: token lists against the cue table as arrays.

The join of tokens with cues has a row per token and category that knows it, ten times the tokens and more; here those products
exist only within a few thousand rows at a time, so nothing is shuffled. The cue table (a row per category and token of the
quotes) is what each worker holds. Results are those of detect.category_scores and detect.best_two.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions import scalars as S

#: Cells of the table (turn, category) at a time; a row is never parted.
AT_ONCE = 4_000_000
NONE = 1 << 30
CATS = "array<struct<detector:string,value:string,turn_index:int,hit:double,score:double,runner_up:string,margin:double>>"


def words(texts):
    """The distinct tokens of each text, null for a null one."""
    return F.transform(texts, lambda t: F.array_distinct(S.tokens(t)))


def as_arrays(rows: list[tuple]) -> dict:
    """(detector, value, token, weight, total) rows as the arrays that best_categories takes; values in the order of their bytes."""
    cats = sorted({(d, v) for d, v, *_ in rows}, key=lambda c: (c[0].encode(), c[1].encode()))
    place, known = {c: i for i, c in enumerate(cats)}, sorted({r[2] for r in rows})
    number, total = {t: i for i, t in enumerate(known)}, np.ones(len(cats))
    token, cat, weight = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for k, (d, v, t, w, s) in enumerate(rows):
        token[k], cat[k], weight[k] = number[t], place[d, v], w
        total[place[d, v]] = s
    order = np.argsort(token, kind="stable")
    names = [d for d, _ in cats]
    spans = [(d, names.index(d), names.index(d) + names.count(d)) for d in dict.fromkeys(names)]
    return {"known": known, "start": np.searchsorted(token[order], np.arange(len(known) + 1)), "cat": cat[order], "weight": weight[order], "total": total, "spans": spans, "values": [v for _, v in cats]}


def _top(score, turn):
    """(place, score) of the best of each row: by score, then the earlier turn, then the order of values; score -1 for none."""
    best = score.max(1)
    same = score == best[:, None]
    at = np.where(same, turn, NONE)
    return (same & (at == at.min(1)[:, None])).argmax(1), best


def best_categories(lists: pa.Array, t: dict) -> pa.Array:
    """CATS of an array of token lists per turn."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    turns = lists.flatten()
    rows = np.flatnonzero(sizes)
    n, cats = len(turns), len(t["total"])
    found = [[np.zeros(0, np.int64)] * 5 + [np.zeros(0)] * 3]
    if n and cats:
        first = (np.cumsum(sizes) - sizes)[rows]
        of = np.repeat(np.arange(len(rows)), sizes[rows])
        index = np.arange(n) - first[of]
        last = np.maximum.reduceat(np.where(turns.is_valid().to_numpy(zero_copy_only=False), index, -1), first)
        ids = pc.index_in(turns.flatten(), value_set=pa.array(t["known"], turns.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.repeat(np.arange(n), pc.list_value_length(turns).fill_null(0).to_numpy(zero_copy_only=False))
        at, ids = at[ids >= 0], ids[ids >= 0]
        many = t["start"][ids + 1] - t["start"][ids]
        cue = np.repeat(t["start"][ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        hit = np.bincount(np.repeat(at * cats, many) + t["cat"][cue], t["weight"][cue], n * cats).reshape(n, cats)
        score, part = hit / t["total"], (index / np.maximum(last[of], 1))[:, None]
        for d, a, b in t["spans"]:
            if d in ("reason", "outcome"):
                score[:, a:b] *= S.position_weight(part, d == "reason")
        score = np.where(hit > 0, np.floor(score * 1e9 + 0.5) / 1e9, -1.0)
        best = np.maximum.reduceat(score, first, axis=0)
        turn = np.minimum.reduceat(np.where(score == best[of], index[:, None], NONE), first, axis=0)
        for k, (_, a, b) in enumerate(t["spans"]):
            s, w = best[:, a:b].copy(), turn[:, a:b]
            one, high = _top(s, w)
            r = np.arange(len(rows))
            s[r, one] = -1.0
            two, next_ = _top(s, w)
            r = r[high >= 0]
            c = one[r] + a
            found.append([rows[r], np.full(len(r), k), c, np.where(next_[r] >= 0, two[r] + a, -1), turn[r, c], hit[first[r] + turn[r, c], c], high[r], high[r] - np.maximum(next_[r], 0.0)])
    row, det, val, nxt, tix, hits, scores, margins = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    values, names = pa.array(t["values"], pa.string()), pa.array([d for d, _, _ in t["spans"]], pa.string())
    columns = [names.take(pa.array(det[order])), values.take(pa.array(val[order])), pa.array(tix[order].astype(np.int32)), pa.array(hits[order]), pa.array(scores[order]), values.take(pa.array(nxt[order], mask=nxt[order] < 0)), pa.array(margins[order])]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(lists)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["detector", "value", "turn_index", "hit", "score", "runner_up", "margin"]))


def with_categories(x: DataFrame, cues: DataFrame) -> DataFrame:
    """x with cats (CATS) for its column words, the token lists of the row's turns."""
    t = as_arrays([tuple(r) for r in cues.select("detector", "value", "token", "weight", "total").collect()])
    keep = [c for c in x.columns if c != "words"]
    most = max(1, AT_ONCE // max(1, len(t["total"])))

    def run(batches):
        for b in batches:
            turns = np.cumsum(pc.list_value_length(b["words"]).fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(turns, (turns[at - 1] if at else 0) + most, "right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), best_categories(part["words"], t)], [*keep, "cats"])
                at = to

    schema = T.StructType([*(x.schema[c] for c in keep), T.StructField("cats", T.DataType.fromDDL(CATS))])
    return x.select(*keep, "words").mapInArrow(run, schema)
