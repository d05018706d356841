"""Scalar functions as column expressions: no Python runs per row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order in which they are tried; "ies" gives "y".
SUFFIXES = ["ations", "ation", "ing", "ies", "ed", "es", "s"]
#: Words too common to tell anything; our own list.
STOPWORDS = "about after again also because been before being could does doing down during each even every from further have having here into itself just like more most much only other over same should some such than that their them then there these they this those through under until very want well were what when where which while will with would your yours".split()
#: Marks that a transcript leaves for bad sound.
MARKERS = r"(?i)\[(inaudible|crosstalk|static|unintelligible|background noise)\]"
WEEKDAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
MONTHS = "january february march april may june july august september october november december".split()


def normalized(c: Column) -> Column:
    """Lower case, words of a-z, 0-9, $, brackets and apostrophes, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), "[—–]", " "), r"[^a-z0-9$\[\]' ]", " "), " +", " "))


def tokens(c: Column) -> Column:
    """Words of at least four characters without marks in brackets and stop words."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\[[^\]]*\]", " "), r"[^a-z0-9$'\- \t\n]", " ")
    words = F.transform(F.split(bare, r"[ \t\n]+"), lambda w: F.regexp_replace(w, r"^[-']+|[-']+$", ""))
    return F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS))


def stemmed(w: Column) -> Column:
    """The word without the first fitting suffix that leaves at least four characters."""
    out = None
    for s in SUFFIXES:
        fits = w.endswith(s) & (F.length(w) - len(s) >= 4)
        base = F.left(w, F.length(w) - len(s))
        base = F.concat(base, F.lit("y")) if s == "ies" else base
        out = F.when(fits, base) if out is None else out.when(fits, base)
    return out.otherwise(w)


def name_tokens(c: Column) -> Column:
    """Words of a field name: humps and underscores part them; longer than two characters, no stop words."""
    spaced = F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2"), r"[_\-.]", " "))
    return F.filter(F.split(spaced, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def is_subsequence(needle: Column, hay: Column) -> Column:
    """Whether the words of needle come in hay in their order; an empty needle doesn't."""
    met = F.aggregate(hay, F.lit(0), lambda i, w: F.when(F.get(needle, i) == w, i + 1).otherwise(i))
    return (F.size(needle) > 0) & (met == F.size(needle))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of an ASCII key, for draws that any engine can repeat."""
    return F.aggregate(F.split(c, ""), F.lit(2166136261).cast("bigint"), lambda h, x: F.when(x == "", h).otherwise((h.bitwiseXOR(F.ascii(x).cast("bigint")) * 16777619).bitwiseAND(F.lit(4294967295))))


def draw(c: Column) -> Column:
    """Uniform in [0, 1) by key."""
    return fnv1a(c) / float(2**32)


def half_up(c: Column, digits: int = 2) -> Column:
    """Rounded half up on the binary double: 0.285 gives 0.28."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def saturated(c: Column, half: float = 4.0) -> Column:
    return c / (c + half)


def position_weight(fraction: Column, early: bool) -> Column:
    """1.25 at the near end of the call, 0.75 at the far one."""
    return 1.25 - 0.5 * fraction if early else 0.75 + 0.5 * fraction


def shaped_confidence(strength: Column, margin: Column, asr: Column) -> Column:
    """Confidence of a reading by its strength, its lead over the runner-up and the sound."""
    sound = clamped((asr - 0.42) / 0.57, 0, 1)
    return half_up(clamped(strength * (0.8 + 0.34 * margin / (margin + 0.06)) * (0.9 + 0.15 * sound), 0.05, 0.97))


def absence_confidence(asr: Column) -> Column:
    return half_up(clamped(0.34 + 0.42 * clamped((asr - 0.42) / 0.57, 0, 1), 0.3, 0.8))


def number_in(c: Column) -> Column:
    """A number with thousands commas, or null."""
    return F.regexp_replace(c, ",", "").try_cast("double")


def same_number(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(number_in(a) - number_in(b)) < 0.005, F.lit(False))


def money(c: Column) -> Column:
    """The first number of a text that speaks of dollars or thousands; a "k" multiplies by 1000, less than 20 is none."""
    pattern = r"(?i)\$?\b(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s?(k\b|dollars\b)?"
    value = number_in(F.regexp_extract(c, pattern, 1)) * F.when(F.lower(F.regexp_extract(c, pattern, 2)) == "k", 1000).otherwise(1)
    return F.when(c.rlike(r"(?i)\$|dollar|\bk\b") & (value >= 20), F.floor(value + 0.5).cast("bigint"))


def retraction(c: Column) -> Column:
    """(retracted, corrected) numbers of "52,329 — no sorry, 12,329", null where there is none."""
    pattern = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*—?\s*no sorry,?\s*(\d[\d,]*(?:\.\d+)?)"
    return F.struct(number_in(F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))).alias("retracted"), number_in(F.nullif(F.regexp_extract(c, pattern, 2), F.lit(""))).alias("corrected"))


def clean_quote(c: Column) -> Column:
    """A quote without marks of bad sound, stutters and fillers."""
    x = F.regexp_replace(c, MARKERS + r"\s*", "")
    x = F.regexp_replace(x, r"(?i)\b([a-z']+)—\s+", "")
    x = F.regexp_replace(x, r"(?i)\b(um|uh|you know|i mean|sort of|kind of|like)\b,?\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"\s+([,.?!])", "$1"))


def noise_penalty(c: Column) -> Column:
    parts = ((MARKERS, 0.22), ("—", 0.08), (r"(?i)\bno sorry\b", 0.1))
    return F.least(F.lit(0.4), sum((F.when(c.rlike(p), w).otherwise(0.0) for p, w in parts[1:]), F.when(c.rlike(parts[0][0]), parts[0][1]).otherwise(0.0)))


def window_quote(c: Column, token: Column, radius: int = 7) -> Column:
    """The words around the first place of a token; the first 160 characters where it isn't."""
    at = F.position(token, F.lower(c))
    before, rest = F.substring(c, F.lit(1), at - 1), F.substring(c, at, F.length(c))
    back = F.regexp_extract(before, rf"((?:\S* ){{0,{radius - 1}}}\S*)$", 1)
    tail = F.substring(rest, F.length(token) + 1, F.length(c))
    ahead = F.regexp_extract(tail, rf"^(\S*(?: \S*){{0,{radius - 1}}})", 1)
    return F.when(at > 0, F.trim(F.concat(back, F.substring(rest, F.lit(1), F.length(token)), ahead))).otherwise(F.left(c, F.lit(160)))


def shortened(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clock(seconds: Column) -> Column:
    return F.concat((seconds.cast("int") / 60).cast("int").cast("string"), F.lit(":"), F.lpad((seconds.cast("int") % 60).cast("string"), 2, "0"))


def day_of_month(captured: Column, day: Column) -> Column:
    """The next date of that day of the month, from the captured date on; a day the month lacks rolls over into the next."""
    this = F.date_add(F.trunc(captured, "month"), day - 1)
    return F.when(this >= captured, this).otherwise(F.date_add(F.add_months(F.trunc(captured, "month"), 1), day - 1))


def relative_weekday(captured: Column, weekday: Column, following: Column) -> Column:
    """The coming weekday (0: Sunday), never today; a week later where following."""
    ahead = F.pmod(weekday - (F.dayofweek(captured) - 1), F.lit(7))
    return F.date_add(captured, (F.when(ahead == 0, 7).otherwise(ahead) + F.when(following, 7).otherwise(0)).cast("int"))


def spoken_date(c: Column, captured: Column) -> Column:
    """(date, confidence) of the first kind of spoken date that a text has, read against the day of the call."""
    x = F.lower(c)
    days, months = "|".join(WEEKDAYS), "|".join(MONTHS)
    part = lambda p, i: F.regexp_extract(x, p, i)
    number = lambda p, i: part(p, i).try_cast("int")
    month_day, week_of, day_the = rf"\b({months})\s+(\d{{1,2}})(st|nd|rd|th)?\b", r"\bweek of the (\d{1,2})(st|nd|rd|th)?\b", rf"\b({days})\s+the\s+(\d{{1,2}})(st|nd|rd|th)?\b"
    bare, relative = r"\bthe (\d{1,2})(st|nd|rd|th)\b", rf"\b(this|next)\s+({days})\b"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), part(month_day, 1)).cast("int")
    answer = lambda d, conf: F.struct(d.alias("date"), F.lit(conf).alias("confidence"))
    weekday = F.array_position(F.array(*map(F.lit, WEEKDAYS)), part(relative, 2)).cast("int") - 1
    following = part(relative, 1) == "next"
    return (
        F.when(captured.isNull(), F.lit(None))
        .when(x.rlike(month_day), answer(F.date_add(F.add_months(F.trunc(captured, "year"), month - 1), number(month_day, 2) - 1), 0.94))
        .when(x.rlike(r"\btomorrow\b"), answer(F.date_add(captured, 1), 0.9))
        .when(x.rlike(week_of), answer(day_of_month(captured, number(week_of, 1)), 0.52))
        .when(x.rlike(day_the), answer(day_of_month(captured, number(day_the, 2)), 0.88))
        .when(x.rlike(bare), answer(day_of_month(captured, number(bare, 1)), 0.78))
        .when(x.rlike(relative) & following, answer(relative_weekday(captured, weekday, following), 0.61))
        .when(x.rlike(relative), answer(relative_weekday(captured, weekday, following), 0.8))
    )
