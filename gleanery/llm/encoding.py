"""Problem 9: text that was read in the wrong character encoding, found and restored by learning from near-twins.

1. Documents are split behind sentence marks into segments; equal segments are counted once (boilerplate is no hot key).
2. Twins: segments with the same skeleton, which is the text stripped of its non-ASCII characters (a slot is left in
   place of each run of them, digits are one digit, white space goes). A skeleton with few letters says nothing, so such a
   segment (as in Cyrillic) has the lengths of its runs in the skeleton as well. Per skeleton one segment is taken as the
   clean one (no replacement or control characters, then the shorter, then the more frequent), by an aggregate, and
   every other is joined to it alone: no pairs within a group are made.
3. Alignment: between twins the runs of a slot correspond; runs of equal length, and runs that divide evenly by the
   clean one's characters, give pairs (garbled characters, clean character).
4. Transformations: a pair votes for every misreading (bytes of one encoding read as another, once or twice over) that
   explains it. The fewest misreadings that explain the pairs are taken; the driver sees the sets of misreadings
   that explain some pair, of which the code tables give few hundred.
5. The taken misreadings are applied to every distinct segment: the segment is garbled by one of them if undoing it gives
   text whose characters stand next to each other much more often in the corpus than before. The corpus' character pairs
   are counted over all segments but the garbled twins into a table of 2^18 hashed places, whatever the size of the corpus.
6. A replacement or control character marks a segment as garbled by itself; where a twin has what was lost, it is restored from it.

A null or empty text has no segments. A text of any length is processed whole. Repeated rows are restored each. No documents:
no rows.
"""

import functools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.common import durable, table

LETTERS_OF_SKELETON, PLACES, PAIRS_LEAST, MARGIN, MARGIN_ALIKE = 12, 1 << 18, 3, 1.0, 3.0
#: Encodings in which text is written, and in which it is read by mistake (names of the standard library).
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "mac_roman")
READ = ("latin-1", "cp1252", "cp1250", "iso8859-2", "iso8859-15", "cp1254", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r")
#: A byte that the encoding read lacks stays as a control character, or is dropped with all control characters.
KEPT, DROPPED = "kept", "dropped"
SEGMENT_END = r"(?<=[.!?;\n])"
LOST = r"[\x{fffd}\x{80}-\x{9f}]"


@functools.cache
def _byte(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


@functools.cache
def misread(c: str, name: tuple) -> str | None:
    """What a clean character becomes under a misreading (written, read, control characters, times)."""
    written, read, control, times = name
    for _ in range(times):
        try:
            c = "".join(_byte(b, read) for b in c.encode(written))
        except UnicodeEncodeError:
            return None
    return re.sub("[\x80-\x9f]", "", c) if control == DROPPED else c


@functools.cache
def misreadings() -> list[tuple]:
    once = [(w, r, KEPT, 1) for w in WRITTEN for r in READ if w != r]
    return once + [("utf-8", r, DROPPED, n) for r in READ for n in (1, 2)] + [("utf-8", r, KEPT, 2) for r in READ]


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, at, segment) of every text; joined in order they are the text."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", SEGMENT_END, -1)).alias("at", "segment")).where("segment <> ''")


def distinct_segments(segs: DataFrame) -> DataFrame:
    """(segment, n) of the segments with a non-ASCII character, each with the documents' rows that hold it."""
    return segs.where(F.col("segment").rlike(r"[^\x00-\x7f]")).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


def skeletons(c: Column) -> Column:
    """The keys under which a segment may meet its twin: the text without its non-ASCII characters, or, where that says
    too little, with the lengths of their runs: as they are, and halved if all are even (two bytes read as two characters)."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\s\x{a0}]+", ""), "[0-9]+", "0"), r"[^\x00-\x7f]+", "\x01")
    lengths = F.transform(F.regexp_extract_all(c, F.lit(r"([^\x00-\x7f]+)")), lambda r: F.length(r))
    letters = F.length(F.regexp_replace(c, r"[^a-zA-Z]+", ""))
    total = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    key = lambda x: F.concat(bare, F.array_join(x.cast("array<string>"), ","))
    halved = F.when(F.forall(lengths, lambda x: x % 2 == 0), F.array(key(F.transform(lengths, lambda x: (x / 2).cast("int"))))).otherwise(F.array())
    by_length = F.when((F.size(lengths) >= 3) & (total >= LETTERS_OF_SKELETON), F.concat(F.array(key(lengths)), halved)).otherwise(F.array())
    return F.when(letters >= LETTERS_OF_SKELETON, F.array(bare)).otherwise(by_length)


def runs(c: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(c, r"(?<=[^\x00-\x7f])\s+(?=[^\x00-\x7f])|\x{a0}", " "), F.lit(r"([^\x00-\x7f]+)"))


def twins(distinct: DataFrame) -> DataFrame:
    """(segment, twin): segments joined to the clean one of their skeleton; those without another are left out."""
    lost = F.col("segment").rlike(LOST)
    s = distinct.select("segment", F.explode(skeletons(F.col("segment"))).alias("key"), F.struct(lost.cast("int").alias("lost"), F.length(F.regexp_replace("segment", r"[\x00-\x7f]", "")).alias("length"), (-F.col("n")).alias("less"), "segment").alias("order"))
    clean = s.groupBy("key").agg(F.min("order").alias("c"), F.count(F.lit(1)).alias("variants")).where("variants > 1 and c.lost = 0")
    joined = s.join(clean, "key").where(F.col("segment") != F.col("c.segment"))
    # a segment with two keys has one twin
    return joined.groupBy("segment").agg(F.min("c").alias("c")).select("segment", F.col("c.segment").alias("twin"))


def aligned(garbled: list[str], clean: list[str]) -> list[tuple[str, str]]:
    """Pairs (garbled characters, clean character) of corresponding runs."""
    out = []
    for g, c in zip(garbled, clean) if len(garbled) == len(clean) else ():
        if g != c and len(g) % len(c) == 0:
            k = len(g) // len(c)
            out += [(g[i * k : i * k + k], c[i]) for i in range(len(c)) if g[i * k : i * k + k] != c[i]]
        elif g != c and len(c) == 1:
            out.append((g, c))
    return out


def pairs(joined: DataFrame) -> DataFrame:
    """(garbled, clean, support): how many distinct twins show a pair."""

    def task(batches):
        import pandas as pd

        for b in batches:
            rows = [p for g, c in zip(b["g"], b["c"]) for p in set(aligned(list(g), list(c)))]
            yield pd.DataFrame(rows, columns=["garbled", "clean"])

    return joined.select(runs(F.col("segment")).alias("g"), runs(F.col("twin")).alias("c")).mapInPandas(task, "garbled string, clean string").groupBy("garbled", "clean").agg(F.count(F.lit(1)).alias("support"))


def votes(learned: DataFrame) -> DataFrame:
    """(explained_by, different, support): pairs and their twins by the set of misreadings that explain them.

    Sets differ by what the encodings make of characters, so there are as many as the code tables give, whatever the data.
    """

    def task(batches):
        import pandas as pd

        names = misreadings()
        for b in batches:
            by = [",".join(str(i) for i, m in enumerate(names) if misread(c, m) == g) for g, c in zip(b["garbled"], b["clean"])]
            yield pd.DataFrame({"explained_by": by, "support": b["support"]})

    v = learned.mapInPandas(task, "explained_by string, support bigint").where("explained_by <> ''")
    return v.groupBy("explained_by").agg(F.count(F.lit(1)).alias("different"), F.sum("support").alias("support"))


def accepted(voted: list) -> list[tuple]:
    """The fewest misreadings that explain the pairs: each time the one with most twins not explained so far.

    One is taken only for PAIRS_LEAST different pairs that no other explains.
    """
    left = [({int(i) for i in r["explained_by"].split(",")}, r["different"], r["support"]) for r in voted]
    out = []
    while left:
        total = {i: (sum(n for s, _, n in left if i in s), sum(d for s, d, _ in left if i in s)) for s, _, _ in left for i in s}
        best = min(total, key=lambda i: (total[i][1] < PAIRS_LEAST, -total[i][0], i))
        if total[best][1] < PAIRS_LEAST:
            break
        out.append(misreadings()[best])
        left = [x for x in left if best not in x[0]]
    return out


def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B1) + b.astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(7)) & np.uint64(PLACES - 1)


def neighbours(text: str) -> np.ndarray:
    """Hashed places of the pairs of neighbouring characters of which one is not ASCII; digits are one digit."""
    codes = np.frombuffer((" " + re.sub("[0-9]", "0", text) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = codes[:-1], codes[1:]
    use = (a > 127) | (b > 127)
    return _place(a[use], b[use])


def character_pairs(distinct: DataFrame) -> np.ndarray:
    """How often, in distinct segments, characters stand next to each other: PLACES counts, whatever the corpus."""

    def task(batches):
        import pandas as pd

        total = np.zeros(PLACES, np.int64)
        for b in batches:
            total += np.bincount(neighbours("  ".join(b["segment"])).astype(np.int64), minlength=PLACES)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"place": at, "n": total[at]})

    out = np.zeros(PLACES)
    for r in distinct.select("segment").mapInPandas(task, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r["place"]] = r["n"]
    return out


def characters(distinct: DataFrame) -> list[str]:
    """The non-ASCII characters in use, the most frequent first; at most as many as Unicode has in its basic plane."""
    rows = distinct.select(F.explode(F.array_distinct(F.split(F.regexp_replace("segment", r"[\x00-\x7f]|[^\x{80}-\x{ffff}]", ""), ""))).alias("c")).where("c <> ''").groupBy("c").count().where("count > 1").collect()
    return [r["c"] for r in sorted(rows, key=lambda r: (-r["count"], r["c"]))]


class Undo:
    """Undoes accepted misreadings and says whether the text is the better for it."""

    def __init__(self, names: list[tuple], alphabet: list[str], counts: np.ndarray):
        self.log = np.log(counts + 0.3)
        self.maps = []
        for m in names:
            table: dict[str, str] = {}
            # the more frequent character wins where a misreading makes two alike
            for c in alphabet:
                g = misread(c, m)
                if g and g != c and any(ord(x) > 127 for x in g):
                    table.setdefault(g, c)
            if table:
                self.maps.append((m, table, re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))))

    def score(self, text: str) -> float:
        p = neighbours(text)
        return float(self.log[p.astype(np.int64)].mean()) if len(p) else math.inf

    def part(self, text: str) -> tuple[str, tuple] | None:
        """The best undoing of a text and its misreading, or None if the text is better as it is."""
        before, best = self.score(text), None
        for m, mapping, pattern in self.maps:
            if not pattern.search(text):
                continue
            fixed = pattern.sub(lambda x: mapping[x[0]], text)
            after = self.score(fixed)
            # one character for one is weaker evidence than several for one
            margin = MARGIN if len(fixed) < len(text) else MARGIN_ALIKE
            if after > before + margin and (best is None or after > best[0] + 1e-9):
                best = (after, fixed, m)
        return best and (best[1], best[2])

    def text(self, segment: str) -> tuple[str, list[tuple]]:
        """Undoes whole, then word by word where a sound part hides a garbled one; again while it helps (texts misread twice)."""
        used = []
        for _ in range(3):
            if found := self.part(segment):
                segment, m = found
                used.append(m)
                continue
            words = re.split(r"(\s+)", segment)
            fixed = [(self.part(w) if any(ord(c) > 127 for c in w) else None) for w in words]
            if not any(fixed):
                break
            segment = "".join(f[0] if f else w for f, w in zip(fixed, words))
            used += [f[1] for f in fixed if f]
        return segment, used


def restored(distinct: DataFrame, joined: DataFrame) -> DataFrame:
    """(segment, fixed, how): garbled segments; how is mapping, twin or lost (where no part of it could be restored)."""
    names = accepted(votes(pairs(joined)).collect())
    # the garbled side of a twin is no example of sound text
    sound = distinct.join(joined, "segment", "left_anti")
    counts, alphabet = character_pairs(sound), characters(distinct)
    state: list[Undo] = []

    def task(batches):
        import pandas as pd

        if not state:
            state.append(Undo(names, alphabet, counts))
        undo = state[0]
        for b in batches:
            rows = []
            for s, twin in zip(b["segment"], b["twin"]):
                lost = bool(re.search("[�\x80-\x9f]", s))
                fixed, used = undo.text(s)
                if not used and not lost:
                    continue
                how = "mapping" if used else "lost"
                if twin is not None and (lost or re.search("[�\x80-\x9f]", fixed)):
                    f, t = re.findall(r"[^\x00-\x7f]+", s), re.findall(r"[^\x00-\x7f]+", twin)
                    if len(f) == len(t):
                        it = iter(t)
                        fixed, how = re.sub(r"[^\x00-\x7f]+", lambda _: next(it), s), "twin"
                elif re.search("[�\x80-\x9f]", fixed):
                    how = "lost"
                rows.append((s, fixed, how, ",".join(sorted({f"{m[0]}>{m[1]}" for m in used}))))
            yield pd.DataFrame(rows, columns=["segment", "fixed", "how", "misreadings"])

    x = distinct.select("segment").join(joined.select("segment", "twin"), "segment", "left")
    return x.mapInPandas(task, "segment string, fixed string, how string, misreadings string")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled distinct segment with what it was restored to."""
    distinct = durable(distinct_segments(segments(table(spark, sf_dir, "documents"))))
    return restored(distinct, durable(twins(distinct)))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, garbled, lost, text): the garbled documents with their restored text."""
    segs = segments(table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null"))
    fixed = durable(p9_segments(spark, sf_dir))
    hit = segs.where(F.col("segment").rlike(r"[^\x00-\x7f]")).join(fixed, "segment").select("doc_id", "at", "segment", "fixed", "how")
    of = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("garbled"), F.count_if(F.col("how") == "lost").alias("lost"))
    parts = segs.join(of.select("doc_id"), "doc_id", "left_semi").join(hit.select("doc_id", "at", "segment", "fixed").distinct(), ["doc_id", "at", "segment"], "left")
    text = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("fixed", "segment").alias("s")))), lambda x: x["s"]), "").alias("text"))
    return of.join(text, "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = p9_segments(spark, sf_dir).select("segment")
    segs = segments(table(spark, sf_dir, "documents")).where(F.col("segment").rlike(r"[^\x00-\x7f]"))
    return segs.join(fixed, "segment", "left_semi").where("doc_id is not null").select("doc_id").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p9_found": p9_found, "p9_segments": p9_segments, "p9_restored": p9_restored}
