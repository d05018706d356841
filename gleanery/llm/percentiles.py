"""Problem 5: percentiles with a deterministic error bound, by collapsing equal-size weighted sorted buffers.

A sketch is a set of sorted buffers of K values; a value of a buffer of level l stands for 2^l values. Two buffers of
one level collapse into one of the next: of their 2K merged values every second is kept, the offset (odd or even
places) alternating by level. The schedule is a tree (a binary counter per group), so n values pass at most log2(n / K)
levels. Collapsing two buffers of weight w moves any rank by at most w / 2 in expectation over offsets and w at most; the
sketch carries the sum of those w as its error bound, so every estimate states how far its rank can be off.

Sketches are built per input partition (mapInArrow), where every task emits few buffers per group, then merged
by group and salt, then by group: a group with a third of all rows is built by all tasks and merged from their
buffers, never from its values. They are rows (group, level, values), so they can be stored and
joined across runs or days: merge() of stored sketches equals a sketch of all values up to the stated bound.

p5_found needs the value at one exact place. The sketch brackets it between two values; where both lie on one side of the
limit the sketch decides, else the spans within the bracket alone are ranked exactly.

Null and negative durations and null groups' keys: the former are left out, the latter are a group of their own. A span id counts once
(of differing deliveries the smallest triple of run, agent and duration). Empty input gives no sketch and no percentile.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import durable, folded, table

K = 1024
QUANTILES = (0.5, 0.95)


class Sketch:
    """Full buffers by level, a partial buffer of level 0 and the rank error so far."""

    def __init__(self, k: int = K):
        self.k, self.n, self.error = k, 0, 0
        self.levels: dict[int, np.ndarray] = {}
        self.rest = np.empty(0)
        self.odd: dict[int, bool] = {}

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while (other := self.levels.pop(level, None)) is not None:
            merged = np.sort(np.concatenate([other, buffer]), kind="stable")
            odd = self.odd[level] = not self.odd.get(level, False)
            buffer, self.error = merged[int(odd) :: 2], self.error + (1 << level)
            level += 1
        self.levels[level] = buffer

    def add(self, values: np.ndarray) -> "Sketch":
        self.n += len(values)
        rest = np.concatenate([self.rest, values])
        full = len(rest) // self.k * self.k
        for i in range(0, full, self.k):
            self._carry(0, np.sort(rest[i : i + self.k]))
        self.rest = np.sort(rest[full:])
        return self

    def merge(self, buffers: list[tuple[int, np.ndarray]], n: int, error: int) -> "Sketch":
        """Buffers (level, values) of another sketch; a level of -1 marks its partial one."""
        self.error += error
        for level, values in sorted(buffers, key=lambda b: b[0]):
            if level < 0:
                self.add(values)
                self.n -= len(values)
            else:
                self._carry(level, values)
        self.n += n
        return self

    def buffers(self) -> list[tuple[int, np.ndarray]]:
        return [*([(-1, self.rest)] if len(self.rest) else []), *sorted(self.levels.items())]


def place(n: int, q: float) -> int:
    """The 0-based place of the nearest-rank rule."""
    return min(n - 1, int(np.floor(q * n + 1e-9)))


def bracket(buffers: list[tuple[int, np.ndarray]], n: int, error: int, q: float) -> tuple[float, float, float]:
    """The estimate at the place of q, and two values between which the true one lies."""
    values = np.concatenate([v for _, v in buffers])
    weights = np.concatenate([np.full(len(v), 1 << max(level, 0)) for level, v in buffers])
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weights[order])
    at = place(n, q)
    pick = lambda rank: float(values[order[min(int(np.searchsorted(upto, rank, side="right")), len(order) - 1)]])
    # a kept value stands for its neighbours too, so the outermost places fall back on the widest claim
    low = pick(at - error) if at - error >= 0 else float("-inf") if error else pick(at)
    high = pick(at + error) if at + error < n else float("inf") if error else pick(at)
    return pick(at), low, high


def _rows(key: tuple, s: Sketch) -> list[tuple]:
    return [(*key, level, values.tolist(), s.n if i == 0 else 0, s.error if i == 0 else 0) for i, (level, values) in enumerate(s.buffers())]


def build(values: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, level, buffer, n, error): sketches of each input partition; a partition keeps at most K log2(n / K) values per group."""
    ddl = {f.name: f.dataType.simpleString() for f in values.schema}
    out = ", ".join(f"`{c}` {ddl[c]}" for c in keys) + ", level int, buffer array<double>, n bigint, error bigint"

    def task(batches):
        import pandas as pd

        sketches: dict[tuple, Sketch] = {}
        for b in batches:
            for key, v in b.groupby(keys, dropna=False, sort=False)[value]:
                key = tuple(None if pd.isna(x) else x for x in key)
                sketches.setdefault(key, Sketch(k)).add(v.to_numpy(float))
        rows = [r for key, s in sketches.items() for r in _rows(key, s)]
        for i in range(0, len(rows), 2_000):
            yield pd.DataFrame(rows[i : i + 2_000], columns=[*keys, "level", "buffer", "n", "error"])

    return values.select(*keys, value).where(F.col(value).isNotNull()).mapInPandas(task, out)


def by_group(df: DataFrame, keys: list[str], one, ddl: str) -> DataFrame:
    """one(key, rows) for each group, where groups are many and small: whole Arrow batches of sorted groups go to Python, not a call per group."""
    names = [c.strip().split(" ")[0].strip("`") for c in ddl.split(", ")]

    def task(batches):
        import pandas as pd

        key, held, rows = None, [], []
        for b in batches:
            for k, g in b.groupby(keys, dropna=False, sort=False):
                k = tuple(None if pd.isna(x) else x for x in k)
                if held and k != key:
                    rows += one(key, pd.concat(held) if len(held) > 1 else held[0])
                    held = []
                key = k
                held.append(g)
                if len(rows) >= 2_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if held:
            rows += one(key, pd.concat(held) if len(held) > 1 else held[0])
        yield pd.DataFrame(rows, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task, ddl)


def _buffers(pdf) -> tuple[list[tuple[int, np.ndarray]], int, int]:
    return [(int(level), np.asarray(v, float)) for level, v in zip(pdf["level"], pdf["buffer"])], int(pdf["n"].sum()), int(pdf["error"].sum())


def merge(sketches: DataFrame, keys: list[str], k: int = K, salts: int | None = None) -> DataFrame:
    """One sketch per keys of many, first by salt, then whole. Keys may be fewer than those the sketches were built by.

    T tasks leave T sketches of a hot group; about sqrt(T) salts make both steps merge about sqrt(T) sketches each.
    """
    salts = salts or max(1, math.isqrt(int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = {f.name: f.dataType.simpleString() for f in sketches.schema}
    ddl = lambda by: ", ".join(f"`{c}` {kind.get(c, 'int')}" for c in by) + ", level int, buffer array<double>, n bigint, error bigint"
    one = lambda key, pdf: _rows(key, Sketch(k).merge(*_buffers(pdf)))
    salted = sketches.withColumn("_salt", F.pmod(F.xxhash64("buffer"), F.lit(salts)).cast("int"))
    return by_group(by_group(salted, [*keys, "_salt"], one, ddl([*keys, "_salt"])), keys, one, ddl(keys))


def estimates(sketches: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, q, n, error, estimate, low, high) of merged sketches."""
    kind = {f.name: f.dataType.simpleString() for f in sketches.schema}

    def one(key, pdf):
        buffers, n, error = _buffers(pdf)
        return [(*key, q, n, error, *bracket(buffers, n, error, q)) for q in quantiles]

    return by_group(sketches, keys, one, ", ".join(f"`{c}` {kind[c]}" for c in keys) + ", q double, n bigint, error bigint, estimate double, low double, high double")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "spans").select("id", "run_id", folded("agent").alias("agent"), "duration_ms")
    return spans.where("duration_ms >= 0").groupBy("id").agg(F.min(F.struct("run_id", "agent", "duration_ms")).alias("s")).select("s.*")


def exact_at(values: DataFrame, brackets: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, q, exact): the values at the places of q, by counting those under the bracket and ranking those within it."""
    x = values.join(brackets.select(*keys, "q", "n", "low", "high"), keys).groupBy(*keys, "q", "n", "low", "high").agg(
        F.count_if(F.col(value) < F.col("low")).alias("under")
    )
    within = values.join(x, keys).where(F.col(value).between(F.col("low"), F.col("high"))).groupBy(*keys, "q", "n", "under", F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("under") + F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    target = F.least(F.col("n") - 1, F.floor(F.col("q") * F.col("n") + 1e-9))
    return within.withColumn("upto", upto).where(F.col("upto") > target).groupBy(*keys, "q").agg(F.min("v").alias("exact"))


def off(reported: Column, true: Column) -> Column:
    return F.abs(reported - true) * 100 > true * 15


def run_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(build(durations(spark, sf_dir), ["run_id", "agent"], "duration_ms"), ["run_id", "agent"])


def p5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: one row per buffer of each run and agent."""
    return run_sketches(spark, sf_dir)


def p5_run_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimates(run_sketches(spark, sf_dir), ["run_id", "agent"])


def p5_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each agent over all runs, from the runs' sketches."""
    return estimates(merge(run_sketches(spark, sf_dir), ["agent"]), ["agent"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls: a rollup row without a reported percentile is not off in it."""
    keys = ["run_id", "agent"]
    est = durable(estimates(run_sketches(spark, sf_dir), keys))
    reported = table(spark, sf_dir, "agent_rollup").select(*keys, F.explode(F.create_map(F.lit(0.5), F.col("p50_ms"), F.lit(0.95), F.col("p95_ms"))).alias("q", "reported"))
    held = reported.where("reported is not null").join(est, [*keys, "q"])
    # off against every value of the bracket, or against none
    surely_off = (off(F.col("reported"), F.col("low")) & off(F.col("reported"), F.col("high"))) & ((F.col("reported") < F.col("low")) | (F.col("reported") > F.col("high")))
    surely_in = ~off(F.col("reported"), F.col("low")) & ~off(F.col("reported"), F.col("high")) & (F.col("high") < float("inf"))
    held = held.withColumn("verdict", F.when(surely_off, True).when(surely_in, False))
    open_cases = held.where("verdict is null")
    exact = exact_at(durations(spark, sf_dir), open_cases.select(*keys, "q", "n", "low", "high").distinct(), keys, "duration_ms")
    settled = open_cases.join(exact, [*keys, "q"]).where(off(F.col("reported"), F.col("exact")))
    return held.where("verdict").select(*keys).unionByName(settled.select(*keys)).distinct()


SQL = {
    "p5_found": r"""
with s as (
  select id, min((run_id, lower(regexp_replace(agent, '^\s+|\s+$', '', 'g')), duration_ms)) x from spans where duration_ms >= 0 group by id
), d as (select x[1] run_id, x[2] agent, x[3] ms from s
), o as (select run_id, agent, ms, row_number() over (partition by run_id, agent order by ms) - 1 place, count(*) over (partition by run_id, agent) n from d
), t as (
  select run_id, agent, max(ms) filter (place = least(n - 1, n * 50 // 100)) p50, max(ms) filter (place = least(n - 1, n * 95 // 100)) p95
  from o group by 1, 2
)
select distinct r.run_id, r.agent from agent_rollup r join t on t.run_id = r.run_id and t.agent = r.agent
where abs(p50_ms - p50) > 0.15 * p50 or abs(p95_ms - p95) > 0.15 * p95
"""
}
QUERIES = {"p5_found": p5_found, "p5_sketches": p5_sketches, "p5_run_agent": p5_run_agent, "p5_agent": p5_agent}
