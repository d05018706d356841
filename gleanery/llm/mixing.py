"""Problem 8: a mix in which each source has its target share of the tokens, by Pareto order sampling.

A source of A tokens whose target is T tokens is repeated r = min(T / A, max_repeats) times: floor(r) certain whole copies
of every document, and a sample of the rest. The rest is drawn with unequal inclusion probabilities p = min(1, c * tokens^ALPHA),
c such that the expected tokens are the wanted ones, as a sample of fixed size: each document gets a random number u from
a hash of its id, ranks by its random odds u / (1 - u) divided by its inclusion odds p / (1 - p), and the n least are taken.

c and n come from counts in bins of the logarithm of the size (at most 640 per source, so p is the same within a bin and
the sums are exact); the n-th rank value is found by a histogram of 4096 bins of the rank value and a sort of the documents
of its one bin, so no source, however large, is ever sorted whole. mix_targets is a table of settings, a row per source.

The total are the tokens of all documents, those of null and unlisted sources included. A source that its repeats can't fill is
reported short; one without documents has no tokens. Sources are compared folded; a document id that comes twice counts
twice; a null or empty text has no tokens and is never sampled, but part of the whole copies.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import durable, folded, table

from .tokens import sized

ALPHA, SEED, RANK_BINS = 0.5, 20_240_101, 4096


def inclusion(counts: np.ndarray, tokens: np.ndarray, wanted: float, alpha: float = ALPHA) -> np.ndarray:
    """Per bin the inclusion probability min(1, c * (mean tokens)^alpha) whose expected tokens are the wanted ones."""
    weight = np.where(tokens > 0, (tokens / counts) ** alpha, 0.0)
    low, high = 0.0, 1 / max(weight[weight > 0].min(initial=np.inf), 1e-12) if (weight > 0).any() else 0.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (np.minimum(1, c * weight) * tokens).sum() < wanted else (low, c)
    return np.minimum(1, high * weight)


def plan(targets: DataFrame, docs: DataFrame, budget: float | None = None) -> tuple[list[dict], list[tuple]]:
    """Per source of the settings what is to be done, and per source and bin the inclusion probability."""
    bins = docs.groupBy("source", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    wanted = targets.select(folded("source").alias("source"), F.col("source").alias("named"), "target_share", "max_repeats").where("source is not null and target_share is not null")
    total = budget if budget is not None else float(docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    by: dict[str, list] = {}
    for r in bins.join(F.broadcast(wanted.select("source").distinct()), "source").collect():
        by.setdefault(r["source"], []).append(r)
    sources, odds = [], []
    for w in wanted.collect():
        rows = by.get(w["source"], [])
        n, t = np.array([r["n"] for r in rows], float), np.array([r["tokens"] for r in rows], float)
        have, target, most = t.sum(), w["target_share"] * total, w["max_repeats"] or 0
        repeats = min(target / have, most) if have else 0.0
        whole = int(repeats + 1e-9)
        p = inclusion(n, t, (repeats - whole) * have) if have and repeats - whole > 1e-9 else np.zeros(len(rows))
        sources.append({"source": w["source"], "named": w["named"], "target_share": w["target_share"], "max_repeats": most, "available": float(have), "target_tokens": float(target), "budget": float(total), "whole": whole, "sample": int(round(float((n * p).sum()))), "short": bool(most * have < target)})
        odds += [(w["source"], r["bin"], float(x)) for r, x in zip(rows, p)]
    return sources, odds


SETTINGS = "source string, named string, target_share double, max_repeats int, available double, target_tokens double, budget double, whole int, sample bigint, short boolean"


def mixed(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mix (source, doc_id, tokens, copies) and the settings (one row per source) of documents (doc_id, source, tokens)."""
    spark = docs.sparkSession
    docs = durable(docs.select("doc_id", folded("source").alias("source"), "tokens", F.floor(16 * F.log2(1 + F.col("tokens"))).cast("int").alias("bin")))
    sources, odds = plan(targets, docs, budget)
    settings = spark.createDataFrame([tuple(s.values()) for s in sources], SETTINGS)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") + 0.5) / float(2**53)
    p = spark.createDataFrame(odds, "source string, bin int, p double")
    ranked = docs.join(F.broadcast(settings.select("source", "whole", "sample")), "source").join(F.broadcast(p), ["source", "bin"])
    q = F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("q", q).withColumn("rank_bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * RANK_BINS), F.lit(RANK_BINS - 1)).cast("int"))
    held = ranked.where("q is not null").groupBy("source", "rank_bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("rank_bin")) - F.col("n")
    edge = held.withColumn("before", before).join(F.broadcast(settings.select("source", "sample")), "source").where("before < sample and sample <= before + n").select("source", F.col("rank_bin").alias("edge_bin"), (F.col("sample") - F.col("before")).alias("of_edge"))
    ranked = ranked.join(F.broadcast(edge), "source", "left")
    below = ranked.where("q is null or edge_bin is null or rank_bin <> edge_bin").withColumn("taken", F.expr("coalesce(q is not null and rank_bin < edge_bin, false)"))
    at = ranked.where("q is not null and rank_bin = edge_bin").withColumn("taken", F.row_number().over(Window.partitionBy("source").orderBy("q", "doc_id")) <= F.col("of_edge"))
    out = below.unionByName(at).select("source", "doc_id", "tokens", (F.col("whole") + F.col("taken").cast("int")).alias("copies")).where("copies > 0")
    return out, settings


def report(mix: DataFrame, settings: DataFrame) -> DataFrame:
    """Per source of the settings: what it reached of its target, its share of the mix, and its most copies of one document."""
    reached = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    x = settings.join(reached, "source", "left").fillna({"reached": 0, "documents": 0, "most_copies": 0})
    share = F.col("reached") / F.nullif(F.sum("reached").over(Window.partitionBy()), F.lit(0))
    return x.select(F.col("named").alias("source"), "target_share", "max_repeats", F.col("available").cast("bigint").alias("available_tokens"), "target_tokens", F.col("reached").alias("reached_tokens"), (F.col("reached") / F.nullif("budget", F.lit(0.0))).alias("share_of_total"), share.alias("share_of_mix"), "documents", "most_copies", "short")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = sized(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mixed(docs, table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*_mixed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_report(spark, sf_dir).where("short").select("source")


SQL: dict[str, str] = {}
QUERIES = {"p8_found": p8_found, "p8_mix": p8_mix, "p8_report": p8_report}
