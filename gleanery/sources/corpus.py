"""A made-up corpus of calls with known facts: every call is a pure function of the seed and its number.

The generator runs per partition over spark.range, so a corpus of any size is made where it is used, and any call can be made alone: draws of
the 32-bit generator are reached directly, as its state only counts up.
"""

from pyspark.sql import DataFrame, SparkSession

MASK, STEP = 0xFFFFFFFF, 0x6D2B79F5
STRATA = ("marina", "optician", "coldstore")
#: Our own phrasebook: what a caller or agent says for each fact.
REASONS = {
    "late_delivery": ["my order was due on Monday and nothing came", "the parcel never arrived"],
    "wrong_charge": ["you took the fee twice", "there is a sum on my bill that I don't know"],
    "broken_part": ["the hinge snapped on the first day", "it came with a crack in it"],
    "change_slot": ["could we move my visit to another day", "I need a later slot"],
    "no_access": ["the code for the gate stopped working", "the keypad stays dark"],
}
OUTCOMES = {"solved": ["all done on my side", "that is put right now"], "visit_booked": ["someone will be with you on {date}", "I have you down for {date}"], "open": ["let's leave it there for today", "I have to ask and ring you back"], "lost": ["I will take my custom elsewhere", "then please close my account"]}
MOODS = {"pleased": ["you have been very kind", "wonderful, thank you"], "even": ["fine, thanks", "all right then"], "cross": ["I am tired of this", "this is not good enough"]}
OBJECTIONS = {"price": ["that is more than I can pay"], "trust": ["I heard that promise before"], "time": ["I can't wait that long"]}
RIVALS = ["Northlight", "Pinegrove", "Saltaire"]
FILLERS = ["um,", "uh,", "you know,", "I mean,"]
#: Sounds that the recogniser confuses.
SWAPS = {"their": "there", "bill": "build", "hinge": "hint", "gate": "great", "slot": "slow", "part": "park"}


def scrambled(state: int) -> float:
    """One draw in [0, 1) of a 32-bit state."""
    t = ((state ^ (state >> 15)) * (state | 1)) & MASK
    t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
    return ((t ^ (t >> 14)) & MASK) / 2**32


def draw_at(seed: int, i: int) -> float:
    """The i-th draw (from 0) of a seed, reached directly."""
    return scrambled((seed + (i + 1) * STEP) & MASK)


def hashed(key: str) -> int:
    h = 2166136261
    for c in key.encode():
        h = ((h ^ c) * 16777619) & MASK
    return h


class Draws:
    def __init__(self, seed: int):
        self.seed, self.i = seed & MASK, 0

    def real(self) -> float:
        self.i += 1
        return draw_at(self.seed, self.i - 1)

    def below(self, n: int) -> int:
        return int(self.real() * n)

    def one(self, items):
        return items[self.below(len(items))]

    def chance(self, p: float) -> bool:
        return self.real() < p

    def weighted(self, weights: dict):
        at = self.real() * sum(weights.values())
        for k, w in weights.items():
            at -= w
            if at < 0:
                return k
        return k

    def shuffled(self, items) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


def facts(d: Draws, stratum: str, day: int) -> dict:
    outcome = d.weighted({"solved": 5, "visit_booked": 3, "open": 2, "lost": 1 if stratum != "optician" else 2})
    mood = d.weighted({"solved": {"pleased": 5, "even": 4, "cross": 1}, "visit_booked": {"pleased": 2, "even": 5, "cross": 2}, "open": {"pleased": 1, "even": 4, "cross": 4}, "lost": {"pleased": 0.2, "even": 2, "cross": 7}}[outcome])
    objection = d.one(sorted(OBJECTIONS)) if d.chance(0.6 if outcome == "lost" else 0.2) else None
    return {
        "reason": d.one(sorted(REASONS)),
        "outcome": outcome,
        "sentiment": mood,
        "objection": objection,
        "competitor": d.one(RIVALS) if d.chance(0.5 if outcome == "lost" else 0.1) else None,
        "dollar_amount": 20 + d.below(900) if d.chance(0.4) else None,
        "commitment_date": day + 1 + d.below(14) if outcome == "visit_booked" else None,
        "disclosure_given": d.chance(0.7),
        "escalation_requested": d.chance({"pleased": 0.02, "even": 0.05, "cross": 0.4}[mood]),
    }


def script(d: Draws, f: dict, date_text) -> list[tuple[str, str]]:
    out = [("IVR", "welcome, your call matters to us")] if d.chance(0.35) else []
    out += [("AGENT", "good day, what can I do"), ("CUSTOMER", d.one(REASONS[f["reason"]]))]
    if f["disclosure_given"]:
        out.append(("AGENT", "this line is recorded so that we learn from it"))
    if f["dollar_amount"]:
        out.append(("AGENT", f"that makes ${f['dollar_amount']} in all"))
    if f["objection"]:
        out.append(("CUSTOMER", d.one(OBJECTIONS[f["objection"]])))
    if f["competitor"]:
        out.append(("CUSTOMER", f"{f['competitor']} would do it for less"))
    if f["escalation_requested"]:
        out.append(("CUSTOMER", "let me talk to whoever runs the place"))
    out += [("AGENT", d.one(OUTCOMES[f["outcome"]]).format(date=date_text)), ("CUSTOMER", d.one(MOODS[f["sentiment"]]))]
    return out


def degraded(d: Draws, turns: list[tuple[str, str]], level: float) -> list[tuple[str, str]]:
    """Fillers, stutters, corrections, misheard words, gaps; then turns cut by others, run together, or given to the wrong speaker."""
    out = []
    for who, text in turns:
        words = text.split()
        if who != "IVR":
            words = [x for w in words for x in ([d.one(FILLERS), w] if d.chance(0.12 * level) else [f"{w}—", w] if d.chance(0.06 * level) else [w])]
            words = [f"{w}— no sorry, {w}" if w.startswith("$") and d.chance(0.3 * level) else w for w in words]
        words = [SWAPS.get(w, w) if d.chance(0.5 * level) else w for w in words]
        words = ["[inaudible]" if d.chance(0.05 * level) else w for w in words]
        out.append((who, " ".join(words)))
    cut = []
    for who, text in out:
        w = text.split()
        if len(w) > 5 and who != "IVR" and d.chance(0.15 * level):
            at = 2 + d.below(len(w) - 4)
            cut += [(who, " ".join(w[:at]) + "—"), ("CUSTOMER" if who == "AGENT" else "AGENT", "mm-hm"), (who, "—" + " ".join(w[at:]))]
        elif cut and cut[-1][0] != who and d.chance(0.06 * level):
            cut[-1] = (cut[-1][0], f"{cut[-1][1]} [crosstalk] {text}")
        else:
            cut.append(("UNKNOWN" if d.chance(0.08 * level) else who, text))
    return [(who, text) for who, text in cut if text.strip()]


def call(seed: int, i: int, start_day: int) -> dict:
    from datetime import date, timedelta

    stratum, call_id = STRATA[i % len(STRATA)], f"call_{STRATA[i % len(STRATA)]}_{i:09d}"
    d = Draws(hashed(call_id) ^ seed)
    day = start_day + int(draw_at(seed, i) * 56)
    f = facts(d, stratum, day)
    as_date = lambda n: date(1970, 1, 1) + timedelta(days=n)
    level = 0.06 + ((d.real() + d.real()) / 2) ** 2 * 0.62
    promised = as_date(f["commitment_date"]) if f["commitment_date"] else None
    turns, t, timed = degraded(d, script(d, f, f"{promised:%B} {promised.day}" if promised else ""), level), 0, []
    for who, text in turns:
        timed.append({"t": t, "speaker": who, "text": text})
        t += 2 + len(text) // 14
    confidence = round(min(0.99, max(0.42, 1 - 0.85 * level + (d.real() - 0.5) * 0.16)), 4)
    return {"call_id": call_id, "pos": i, "stratum": stratum, "captured_at": as_date(day), "duration_sec": t, "asr_confidence": confidence, "turns": timed, **{k: v for k, v in f.items() if k != "commitment_date"}, "commitment_date": promised}


FACTS = "reason string, outcome string, sentiment string, objection string, competitor string, dollar_amount bigint, disclosure_given boolean, escalation_requested boolean, commitment_date date"
DDL = "call_id string, pos int, stratum string, captured_at date, duration_sec int, asr_confidence double, turns array<struct<t:int,speaker:string,text:string>>, " + FACTS


def corpus(spark: SparkSession, size: int, seed: int = 11, start_day: int = 19_723) -> DataFrame:
    """Calls with their facts; the same rows whatever the number of partitions."""

    def task(batches):
        import pandas as pd

        names = [c.split()[0] for c in DDL.replace("array<struct<t:int,speaker:string,text:string>>", "a").split(", ")]
        for b in batches:
            yield pd.DataFrame([call(seed, int(i), start_day) for i in b["id"]], columns=names)

    return spark.range(size).mapInPandas(task, DDL)
