"""Problem 7: documents into containers of fixed capacity by the linear grouping scheme.

1. A text longer than the capacity is cut into whole containers and a rest; no other text is cut.
2. Items above SMALL of the capacity are large. They are ranked by size, split into GROUPS groups of equal cardinality, and
   rounded up to the largest of their group, which leaves few sizes.
3. Over those few sizes the number of containers of each configuration (a multiset of sizes that fits) is optimised as a
   linear program by column generation: a simplex over configurations, priced by a knapsack. It sees counts only.
4. The rounded-down numbers of containers get the actual items by rank; the few items left over (fewer than the
   configurations' slots) are best-fitted one by one.
5. Small items are best-fitted, largest first, into the room left, shard by shard of containers and small items.

The driver holds a histogram of sizes (at most as many rows as the capacity has tokens) and configurations (at most
GROUPS with a few entries each), however many documents there are. Ranks within one size are counted by salt, so one
size may hold any share of the rows. A shard holds about SHARD_TOKENS tokens, so it doesn't grow with the data.

A doc_id that comes twice is one item, of its largest size; null ids are left out; an empty or null text is a small item of no
size. No documents: no rows.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import durable, table

from .tokens import sized

GROUPS, SMALL, SALTS, SHARD_TOKENS = 24, 1 / 8, 32, 20_000_000
OUT = "container_kind string, container_id string, doc_id bigint, chunk_no int, tokens bigint, oversized boolean"


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: a knapsack by number of items, of which few fit as all are large."""
    most = capacity // int(sizes.min())
    best, choice = np.zeros(capacity + 1), []
    useful = [g for g in range(len(sizes)) if worth[g] > 0]
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g in useful:
            with_g = best[: capacity + 1 - sizes[g]] + worth[g]
            better = with_g > new[sizes[g] :] + 1e-12
            new[sizes[g] :][better], pick[sizes[g] :][better] = with_g[better], g
        choice.append(pick)
        best = new
    out, c = np.zeros(len(sizes), int), capacity
    for pick in reversed(choice):
        if pick[c] >= 0:
            out[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(worth @ out), out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, steps: int = 500) -> list[tuple[np.ndarray, float]]:
    """(configuration, number) of the linear program min sum(number), where the configurations hold the counts exactly."""
    basis = np.diag(capacity // sizes).astype(float)
    x = counts / np.diag(basis)
    for _ in range(steps):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        gain, column = best_configuration(sizes, duals, capacity)
        if gain <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        x = np.maximum(x - step * ratios[out], 0)
        x[out], basis[:, out] = ratios[out], column
    return [(basis[:, i].astype(int), x[i]) for i in range(len(sizes)) if x[i] > 0]


def linear_grouping(histogram: list[tuple[int, int]], capacity: int, groups: int = GROUPS) -> tuple[dict[int, int], list[tuple[int, int, int, int]], int]:
    """Of a histogram of large sizes: the first rank of each size, slots (first rank, end, items per container, first container) and the number of containers.

    Ranks go from the largest size downwards, so a rank is worth at most the rounded size of its slot.
    """
    histogram = sorted(histogram, reverse=True)
    sizes, counts = np.array([s for s, _ in histogram]), np.array([n for _, n in histogram])
    ends = np.cumsum(counts)
    n = int(ends[-1])
    starts = sorted({n * g // min(groups, n) for g in range(min(groups, n))})
    rounded = sizes[np.searchsorted(ends, starts, side="right")]
    of_group = np.diff([*starts, n])
    # groups of one rounded size are one
    few, index = np.unique(-rounded, return_inverse=True)
    few, total = -few, np.bincount(index, of_group).astype(int)
    first = {i: starts[list(index).index(i)] for i in range(len(few))}
    used, slots, containers = np.zeros(len(few), int), [], 0
    for configuration, number in configurations(few, total.astype(float), capacity):
        number = int(number + 1e-6)
        number = min([number, *((total - used)[configuration > 0] // configuration[configuration > 0])])
        if number:
            for g in np.flatnonzero(configuration):
                at = first[g] + used[g]
                slots.append((int(at), int(at + number * configuration[g]), int(configuration[g]), containers))
                used[g] += number * configuration[g]
            containers += int(number)
    rooms: list[list[int]] = []  # [room, container] of the items left over
    for g in range(len(few)):
        for rank in range(first[g] + used[g], first[g] + total[g]):
            fits = [r for r in rooms if r[0] >= few[g]]
            if fits:
                best = min(fits)
            else:
                rooms.append(best := [capacity, containers])
                containers += 1
            best[0] -= int(few[g])
            slots.append((int(rank), int(rank) + 1, 1, best[1]))
    offset = {int(s): int(e - c) for s, e, c in zip(sizes, ends, counts)}
    return offset, slots, containers


def best_fit(sizes: np.ndarray, rooms: np.ndarray, capacity: int) -> np.ndarray:
    """For each item, largest first, the container of least sufficient room; containers beyond the given ones are new."""
    stacks: dict[int, list[int]] = {}
    mask = 0
    for i, r in enumerate(rooms):
        stacks.setdefault(int(r), []).append(i)
        mask |= 1 << int(r)
    out, new = np.zeros(len(sizes), int), len(rooms)
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        enough = mask >> s
        if enough:
            room = s + (enough & -enough).bit_length() - 1
            c = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            c, room, new = new, capacity, new + 1
        out[i] = c
        stacks.setdefault(room - s, []).append(c)
        mask |= 1 << (room - s)
    return out


def pack(items: DataFrame, kind: str, capacity: int) -> DataFrame:
    """(container_kind, container_id, doc_id, chunk_no, tokens, oversized) of documents (doc_id, tokens)."""
    spark = items.sparkSession
    # an oversized text gives its whole containers and, if any, a rest; any other text is one chunk
    chunks = F.when(F.col("tokens") <= capacity, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.expr(f"cast((tokens - 1) div {capacity} as int)")))
    cut = items.select("doc_id", (F.col("tokens") > capacity).alias("oversized"), F.col("tokens").alias("all_tokens"), F.posexplode(chunks).alias("_p", "chunk_no")).drop("_p")
    cut = cut.withColumn("tokens", F.least(F.lit(capacity), F.col("all_tokens") - F.col("chunk_no") * capacity)).drop("all_tokens")
    # a container filled by one chunk of an oversized text is closed
    closed = cut.where(F.col("oversized") & (F.col("tokens") == capacity)).select(F.concat_ws(":", F.lit("whole"), "doc_id", "chunk_no").alias("container_id"), "doc_id", "chunk_no", "tokens", "oversized")
    open_ = cut.where(~(F.col("oversized") & (F.col("tokens") == capacity)))
    large = open_.where(F.col("tokens") > capacity * SMALL).withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(SALTS)))
    small = open_.where(F.col("tokens") <= capacity * SMALL)
    counts = large.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = [(r[0], r[1]) for r in counts.groupBy("tokens").agg(F.sum("n")).collect()]
    out = closed
    rooms = None
    if histogram:
        offset, slots, _ = linear_grouping(histogram, capacity)
        before = F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
        offsets = spark.createDataFrame(list(offset.items()), "tokens bigint, first bigint")
        base = counts.join(F.broadcast(offsets), "tokens").select("tokens", "salt", (F.col("first") + F.coalesce(before, F.lit(0))).alias("base"))
        ranked = large.withColumn("k", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "chunk_no")) - 1)
        ranked = ranked.join(base, ["tokens", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
        # slots tile the ranks; the slot of a rank is found by its position among the slots' starts
        slots = sorted(slots)
        starts = F.array(*(F.lit(s[0]).cast("bigint") for s in slots))
        part = lambda i: F.array(*(F.lit(s[i]).cast("bigint") for s in slots))
        look = spark.range(1).select(starts.alias("starts"), part(2).alias("each"), part(3).alias("container"))
        placed = ranked.join(F.broadcast(look)).withColumn("slot", F.expr("aggregate(array(1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20), struct(0 as lo, size(starts) as hi), (a, _) -> if(a.hi - a.lo <= 1, a, if(starts[(a.lo + a.hi) div 2] <= rank, struct(cast((a.lo + a.hi) div 2 as int) as lo, a.hi as hi), struct(a.lo as lo, cast((a.lo + a.hi) div 2 as int) as hi))), a -> a.lo)"))
        placed = durable(placed.select(F.expr("container[slot] + (rank - starts[slot]) div each[slot]").alias("c"), "doc_id", "chunk_no", "tokens", "oversized"))
        rooms = placed.groupBy("c").agg((F.lit(capacity) - F.sum("tokens")).alias("room")).select(F.concat_ws(":", F.lit("mixed"), "c").alias("container_id"), "room")
        out = out.unionByName(placed.withColumn("container_id", F.concat_ws(":", F.lit("mixed"), "c")).drop("c"))
    total = small.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    if total[1]:
        shards = max(1, -(-max(total[0], total[1] * 16) // SHARD_TOKENS))
        rooms = rooms if rooms is not None else spark.createDataFrame([], "container_id string, room bigint")
        left = rooms.withColumn("shard", F.pmod(F.xxhash64("container_id"), F.lit(shards)))
        right = small.withColumn("shard", F.pmod(F.xxhash64("doc_id", "chunk_no"), F.lit(shards)))

        def fit(key, rooms_pdf, items_pdf):
            import pandas as pd

            items_pdf = items_pdf.sort_values(["doc_id", "chunk_no"])
            rooms_pdf = rooms_pdf.sort_values("container_id")
            at = best_fit(items_pdf["tokens"].to_numpy(), rooms_pdf["room"].to_numpy(), capacity)
            names = rooms_pdf["container_id"].tolist()
            ids = [names[c] if c < len(names) else f"small:{key[0]}:{c - len(names)}" for c in at]
            return pd.DataFrame({"container_id": ids, **{c: items_pdf[c] for c in ("doc_id", "chunk_no", "tokens", "oversized")}})

        ddl = "container_id string, doc_id bigint, chunk_no int, tokens bigint, oversized boolean"
        out = out.unionByName(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(fit, ddl))
    return out.select(F.lit(kind).alias("container_kind"), F.concat(F.lit(f"{kind}:"), "container_id").alias("container_id"), "doc_id", "chunk_no", "tokens", "oversized")


def assignment(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    items = sized(table(spark, sf_dir, "documents").where("doc_id is not null"), ["doc_id"], vocabulary).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    items = durable(items)
    out = spark.createDataFrame([], OUT)
    # containers is a table of settings with a row per kind of container
    for kind, capacity in sorted(map(tuple, table(spark, sf_dir, "containers").where("capacity_tokens > 0 and container_kind is not null").select("container_kind", "capacity_tokens").distinct().collect())):
        out = out.unionByName(pack(items, kind, capacity))
    return out


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assignment(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers used, the least number any packing needs, and the share of room left unused."""
    used = assignment(spark, sf_dir).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    x = used.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("items").alias("chunks"))
    x = x.join(table(spark, sf_dir, "containers"), "container_kind")
    return x.select("container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "chunks", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized documents of the assignment: those it had to cut."""
    return assignment(spark, sf_dir).where("oversized").select("container_kind", "doc_id").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p7_found": p7_found, "p7_assignment": p7_assignment, "p7_report": p7_report}
