"""Problem 6: raw transcript records as clean speaker turns in order of time.

The tokens of every record are tagged speaker, stamp, annotation, filler or speech by a chain model (a conditional random field
trained on the labelled talk of talk.py), decoded by Viterbi. Turns are assembled from the tags: a leading stamp gives the time
where t is missing, a speaker label names the speaker, what is tagged speech is the text.

A call delivered twice counts as first delivered; an exact repeat of a record counts once. Times are seconds or, if the call's
stamps, length or spacing say so, milliseconds; a record without any time stays behind the one it was delivered after, and
records of one time keep their order. A speaker that neither label nor column names is UNKNOWN. Records without words
are dropped, then neighbours of one speaker are one turn. A null call_id is a call of its own; null or empty turns
give no rows. Texts of any length are tagged whole.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.common import table

from . import crf

#: What speakers are called.
SPEAKERS = {
    "AGENT": "agent, agt, agnet, advisor, adviser, rep, representative, csr, operator, service rep, service representative",
    "CUSTOMER": "customer, cust, custmer, client, caller",
    "IVR": "ivr, system, recording, automated voice, auto-attendant, auto attendant",
}
SPEAKER_OF = {w: s for s, words in SPEAKERS.items() for w in words.split(", ")}
SPEECH, SPEAKER, STAMP, FILLER = 0, 1, 2, 4
#: Phrases that can be empty, and the letters of hesitations.
PHRASES = {"you know", "i mean", "kind of", "sort of", "you see", "like", "well", "so", "actually", "basically"}
HESITATION = re.compile("[aeuo]*[hmrn]*[aeuo]?[hm]*", re.I)
MODEL = "tags"


def folded_speaker(raw: str | None) -> str:
    """The speaker a label names, without numbers, remarks and marks around it."""
    bare = re.sub(r"\([^)]*\)|\d+|[^\w\s-]|_", " ", raw or "").lower()
    return SPEAKER_OF.get(" ".join(bare.split()).strip(" -"), "UNKNOWN")


def seconds(stamp: str) -> int:
    total = 0
    for part in re.findall(r"\d+", stamp)[:3]:
        total = total * 60 + int(part)
    return total


class Tagged:
    """A record's parts by its tags."""

    __slots__ = ("text", "at", "stamp", "speaker")

    def __init__(self, raw: str, start, end, tags):
        chars, at, last = [], [], 0
        self.stamp, self.speaker = None, "UNKNOWN"
        head, label = [], []
        spoken = stamped = False
        for s, e, t in zip(start, end, tags):
            if t == SPEECH:
                if s > last and at:
                    chars.append(" ")
                    at.append(s - 1)
                chars.append(raw[s:e])
                at += range(s, e)
                last = e
                spoken = spoken or any(c.isalnum() for c in raw[s:e])
            elif t == STAMP and not spoken and not stamped:
                head.append(raw[s:e])
            elif t == SPEAKER and not spoken:
                label.append(raw[s:e])
            # of several leading stamps the first one tells the time
            stamped = stamped or (bool(head) and t != STAMP)
        self.text, self.at = "".join(chars), at
        if any(h.isdigit() for h in head):
            self.stamp = seconds(" ".join(head))
        if label:
            self.speaker = folded_speaker(" ".join(label))


def checked(raw: str, start, end, tags: list[int]) -> list[int]:
    """Words tagged filler that are neither a hesitation nor a whole empty phrase are speech after all."""
    out, i = list(tags), 0
    while i < len(tags):
        run = []
        while i < len(tags) and tags[i] == FILLER:
            w = raw[start[i] : end[i]]
            if w[0].isalnum() and not HESITATION.fullmatch(w):
                run.append(i)
            elif run and not w[0].isalnum():
                break
            i += 1
        if run and " ".join(raw[start[j] : end[j]] for j in run).lower() not in PHRASES:
            for j in run:
                out[j] = SPEECH
        i += 1
    return out


def tagged(texts: list[str], documents: list[int] | None = None) -> list[Tagged]:
    model = crf.load(MODEL)
    batch = crf.Batch(texts, documents)
    tags = model.viterbi(model.emissions(batch.features()), batch)
    f, start, end, tags = batch.first, batch.start.tolist(), batch.end.tolist(), tags.tolist()
    out = []
    for i, x in enumerate(texts):
        s, e = start[f[i] : f[i + 1]], end[f[i] : f[i + 1]]
        out.append(Tagged(x, s, e, checked(x, s, e, tags[f[i] : f[i + 1]])))
    return out


def words(text: str) -> int:
    return sum(any(c.isalnum() for c in w) for w in text.split())


def in_milliseconds(times: list[int], stamped: list[tuple[int, int]], duration: int | None) -> bool:
    """Whether a call's t are milliseconds: by its stamps, else its length, else their spacing."""
    if stamped:
        t, s = max(stamped)
        return t > 60 and t > 30 * max(s, 1)
    if not times:
        return False
    if duration:
        return max(times) > 30 * duration
    gaps = np.diff(np.unique(times))
    return bool(np.median(gaps) > 600) if len(gaps) else times[0] > 20_000


def assembled(records: list[tuple], parts: list[Tagged], duration: int | None) -> list[dict]:
    """The clean turns of one call's distinct records (t, speaker, text)."""
    stamped = [(t, p.stamp) for (t, _, _), p in zip(records, parts) if t is not None and p.stamp is not None]
    millis = in_milliseconds([t for t, _, _ in records if t is not None], stamped, duration)
    timed, last = [], 0
    for (t, speaker, _), p in zip(records, parts):
        last = (t / 1000 if millis else t) if t is not None else p.stamp if p.stamp is not None else last
        timed.append((last, speaker, p))
    out: list[dict] = []
    for at, speaker, p in sorted(timed, key=lambda r: r[0]):
        n = words(p.text)
        if not n:
            continue
        who = p.speaker if p.speaker != "UNKNOWN" else folded_speaker(speaker)
        if out and out[-1]["speaker"] == who:
            out[-1]["text"] += " " + p.text
            out[-1]["n_words"] += n
        else:
            out.append({"turn_no": len(out), "speaker": who, "start_sec": int(at), "text": p.text, "n_words": n})
    return out


def clean_turns(calls: list[tuple[list | None, int | None]]) -> list[list[dict]]:
    """The clean turns of calls (turns, duration), tagged as one batch."""
    records = [list(dict.fromkeys((r["t"], r["speaker"], r["text"] or "") for r in turns or [] if r)) for turns, _ in calls]
    texts, documents = [x for rs in records for _, _, x in rs], [i for i, rs in enumerate(records) for _ in rs]
    parts = iter(tagged(texts, documents))
    return [assembled(rs, [next(parts) for _ in rs], duration) for rs, (_, duration) in zip(records, calls)]


def chunks(rows: list, size: int = 500):
    for i in range(0, len(rows), size):
        yield rows[i : i + size]


def _batches(batches):
    import pyarrow as pa

    names = ("turn_no", "speaker", "start_sec", "text", "n_words")
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())
    for b in batches:
        for rows in chunks(b.to_pylist()):
            turns = clean_turns([(r["turns"], r["duration_sec"]) for r in rows])
            flat = [(r["call_id"], x) for r, ts in zip(rows, turns) for x in ts]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in flat], pa.string()), *(pa.array([x[n] for _, x in flat], k) for n, k in zip(names, kinds))], names=["call_id", *names])


def first_delivered(transcripts: DataFrame) -> DataFrame:
    return transcripts.groupBy("call_id").agg(F.min_by(F.struct("turns", "duration_sec"), F.coalesce("ingested_at", F.lit("9999-12-31").cast("timestamp"))).alias("c")).select("call_id", "c.*")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = first_delivered(table(spark, sf_dir, "transcripts"))
    return calls.mapInArrow(_batches, "call_id string, turn_no int, speaker string, start_sec int, text string, n_words int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_turns(spark, sf_dir).select("call_id", "turn_no", "speaker", "start_sec", "n_words")


SQL: dict[str, str] = {}
QUERIES = {"p6_found": p6_found, "p6_turns": p6_turns}
