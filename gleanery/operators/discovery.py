"""Finding a schema in a small sample: proposals per slice, their similarity, average-linkage clusters, and the rules that settle a column.

The sample and what is proposed from it are small by construction (a few dozen calls, at most slices x detectors proposals), so
clustering runs on the driver over those rows; everything before is a DataFrame over the sampled calls.
"""

import math
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.common import durable, table
from gleanery.functions import scalars as S

from . import cells as C
from .detect import extracted
from .sampling import SLICES, sliced, stratified
from .texts import _STOP, _TOKENS

#: The documented thresholds.
MERGE_ABOVE, MIN_SUPPORT, NEAR_CONSTANT, REQUIRED, MIN_POSITIVES, PEAK = 0.34, 2, 0.9, 0.55, 2, 0.75
NONE = "∅"


def proposals(cells_: DataFrame, sample: DataFrame, aliases: DataFrame) -> DataFrame:
    """(proposer, name, description, type, values, calls, prevalence): per slice the detectors that fired often or strongly enough.

    aliases is (field, description, type, names); each proposer calls a field by another of its names.
    """
    s = sample.select("call_id", "slice")
    size = s.groupBy("slice").agg(F.count(F.lit(1)).alias("size"))
    x = cells_.join(F.broadcast(s), "call_id").where("value is not null and value <> 'false'")
    g = x.groupBy("slice", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), F.array_sort(F.collect_set("call_id")).alias("calls"), F.max("strength").alias("peak"))
    g = g.where((F.size("calls") >= MIN_POSITIVES) | (F.col("peak") >= PEAK)).join(F.broadcast(size), "slice").join(F.broadcast(aliases), "field", "left")
    names = F.coalesce("names", F.array("field"))
    return g.select(F.col("slice").alias("proposer"), F.element_at(names, F.col("slice") % F.size(names) + 1).alias("name"), F.coalesce("description", "field").alias("description"), F.coalesce("type", F.lit("boolean")).alias("type"), "values", "calls", (F.size("calls") / F.col("size")).alias("prevalence"))


def overlap(a: set, b: set, weight: dict | None = None) -> float:
    """Shared weight over that of the lighter set."""
    w = (lambda s: sum(weight.get(x, 1.0) for x in s)) if weight else len
    return w(a & b) / min(w(a), w(b)) if a and b and min(w(a), w(b)) else 0.0


def words_of(text: str) -> set[str]:
    spaced = re.sub(r"[_\-.]", " ", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text or "")).lower()
    return {w for w in re.findall("[a-z0-9]+", spaced) if len(w) > 2 and w not in S.STOPWORDS}


def similarity(a: dict, b: dict, weight: dict) -> float:
    """The best of names, descriptions and values; none within one proposer or across types. Few or two values say nothing."""
    if a["proposer"] == b["proposer"] or a["type"] != b["type"]:
        return 0.0
    values = overlap(set(a["values"]), set(b["values"])) if a["type"] != "boolean" and len(set(a["values"]) | set(b["values"])) >= 3 else 0.0
    return max(overlap(words_of(a["name"]), words_of(b["name"])), overlap(words_of(a["description"]), words_of(b["description"]), weight), values)


def clusters(rows: list[dict]) -> list[list[int]]:
    """Average linkage: the most similar pair of clusters without a common proposer is merged while it is above MERGE_ABOVE."""
    seen = Counter(w for r in rows for w in words_of(r["description"]))
    weight = {w: math.log((len(rows) + 1) / (n + 0.5)) for w, n in seen.items()}
    sim = {(i, j): similarity(rows[i], rows[j], weight) for i, j in combinations(range(len(rows)), 2)}
    groups = [[i] for i in range(len(rows))]
    while True:
        best = None
        for a, b in combinations(range(len(groups)), 2):
            if {rows[i]["proposer"] for i in groups[a]} & {rows[j]["proposer"] for j in groups[b]}:
                continue
            s = sum(sim[min(i, j), max(i, j)] for i in groups[a] for j in groups[b]) / (len(groups[a]) * len(groups[b]))
            if s > MERGE_ABOVE and (best is None or s > best[0] + 1e-12):
                best = (s, a, b)
        if best is None:
            return groups
        groups[best[1]] += groups.pop(best[2])


def settled(rows: list[dict], groups: list[list[int]]) -> list[tuple]:
    """(name, description, type, enum_values, support, prevalence, required, rejected): one row per cluster, the rejected with their reason."""
    out = []
    for g in groups:
        members = [rows[i] for i in g]
        support, prevalence = len({m["proposer"] for m in members}), sum(m["prevalence"] for m in members) / len(members)
        votes = Counter(m["name"] for m in members)
        name = min(votes, key=lambda n: (-votes[n], len(n), n))
        kind = Counter(m["type"] for m in members).most_common(1)[0][0]
        values = Counter(v for m in members for v in m["values"] if v != NONE)
        share = max(values.values()) / sum(values.values()) if values else 1.0
        rejected = "too few proposers" if support < MIN_SUPPORT else "nearly constant" if kind == "enum" and share >= NEAR_CONSTANT else None
        out.append((name, max((m["description"] for m in members), key=len), kind, sorted(values) if kind == "enum" else None, support, round(prevalence, 6), prevalence >= REQUIRED, rejected))
    return sorted(out, key=lambda r: (r[7] is not None, -r[4], -r[5], r[0]))


SCHEMA = "field string, description string, type string, enum_values array<string>, support int, prevalence double, required boolean, rejected string"


def discovered(spark, sf_dir) -> DataFrame:
    """Sample, slices, proposals, clusters, schema."""
    rows = [r.asDict() for r in q_proposals(spark, sf_dir).orderBy("proposer", "name").collect()]
    return spark.createDataFrame(settled(rows, clusters(rows)), SCHEMA)


def q_proposals(spark, sf_dir):
    aliases = table(spark, sf_dir, "schema_fields").select("field", "description", "type", F.coalesce("merged_from", F.array("field")).alias("names"))
    # the sample is drawn from all calls, once; its calls alone are read, with the cues of all cells
    sample = durable(sliced(stratified(C.calls(spark, sf_dir)), SLICES))
    return proposals(extracted(spark, sf_dir, sample), sample, aliases)


def q_overlap_similarity(spark, sf_dir):
    """Overlap of the token sets of any two fields' names and descriptions; the schema has a row per field."""
    f = table(spark, sf_dir, "schema_fields").select("field", "field_ord", F.array_distinct(F.concat(S.name_tokens(F.col("field")), S.tokens(F.coalesce("description", F.lit(""))))).alias("t"))
    a, b = f.select(F.col("field").alias("a"), F.col("field_ord").alias("ao"), F.col("t").alias("ta")), f.select(F.col("field").alias("b"), F.col("field_ord").alias("bo"), F.col("t").alias("tb"))
    x = a.join(F.broadcast(b), F.col("ao") < F.col("bo"))
    return x.select("a", "b", F.round(F.size(F.array_intersect("ta", "tb")) / F.nullif(F.least(F.size("ta"), F.size("tb")), F.lit(0)), 6).alias("overlap"))


def q_discovered_schema(spark, sf_dir):
    return discovered(spark, sf_dir)


_NT = rf"list_filter(string_split_regex(lower(regexp_replace(regexp_replace(field, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_\-.]', ' ', 'g')), '\s+'), lambda w: length(w) > 2 and not list_contains([{_STOP}], w))"
QUERIES = {"proposals": q_proposals, "overlap_similarity": q_overlap_similarity, "discovered_schema": q_discovered_schema}
_TOK = _TOKENS.format("coalesce(description, '')", _STOP)
SQL = {"overlap_similarity": f"with f as (select field, field_ord, list_distinct(list_concat({_NT}, {_TOK})) t from schema_fields) select a.field a, b.field b, round(len(list_intersect(a.t, b.t)) / nullif(least(len(a.t), len(b.t)), 0), 6) overlap from f a join f b on a.field_ord < b.field_ord"}
