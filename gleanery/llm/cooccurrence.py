"""Problem 3: pairs of items that share more baskets than chance gives, by heavy-light decomposition.

An item is heavy if it is in at least 1/64 of all baskets: from there on a dense bit per basket is smaller than a
list of 64-bit basket numbers. Baskets are hashed into blocks of about BLOCK baskets, and each block counts on its own:

* heavy-heavy: a dense bit matrix (heavy items x baskets of the block), pairs by popcount of the rows' conjunction;
* light-light: pairs made within each basket and counted by hash;
* heavy-light: the light item's list of baskets probes the heavy items' bits.

The blocks' partial counts are united and summed per pair. There are at most 64 x (items per basket) heavy items, whatever
the data, and their list is broadcast on that ground. No basket is cut: a block holds whole baskets, distinct
items each; a basket's light pairs are made in one task, which is quadratic in the items of a single basket only.

Rows with a null basket, field or item are no items; repeated rows count once; empty input gives no pairs. The same
item under two fields is two items. Columns of other names are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.common import durable, folded, table

BLOCK = 16_384
HEAVY_SHARE = 1 / 64


def pair_counts(pdf):
    """Counts (a, b, shared), a < b, of one block (basket, item_id, field_id, heavy), by the three ways."""
    import pandas as pd

    baskets, at = np.unique(pdf["basket"].to_numpy(), return_inverse=True)
    item, field, heavy = pdf["item_id"].to_numpy(), pdf["field_id"].to_numpy(), pdf["heavy"].to_numpy(bool)
    out = []
    field_of = dict(zip(item, field))
    heavies = np.unique(item[heavy])
    if len(heavies):
        row = np.searchsorted(heavies, item[heavy])
        dense = np.zeros((len(heavies), len(baskets)), bool)
        dense[row, at[heavy]] = True
        bits = np.packbits(dense, axis=1)
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
        for i in range(len(heavies) - 1):
            shared = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1)
            out += [(heavies[i], heavies[i + 1 + j], int(shared[j])) for j in np.flatnonzero(shared)]
    light = ~heavy
    if light.any():
        order = np.lexsort((at[light], item[light]))
        li, lb = item[light][order], at[light][order]
        starts = np.flatnonzero(np.r_[True, li[1:] != li[:-1]])
        for s, e in zip(starts, np.r_[starts[1:], len(li)]):
            if len(heavies):
                shared = dense[:, lb[s:e]].sum(axis=1)
                out += [(min(li[s], heavies[j]), max(li[s], heavies[j]), int(shared[j])) for j in np.flatnonzero(shared)]
        few = pd.DataFrame({"b": lb, "i": li})
        few = few[few.groupby("b")["i"].transform("size") > 1]
        both = few.merge(few, on="b")
        both = both[both["i_x"] < both["i_y"]].groupby(["i_x", "i_y"]).size()
        out += [(x, y, int(n)) for (x, y), n in both.items()]
    out = [(a, b, n) for a, b, n in out if field_of[a] != field_of[b]]
    return pd.DataFrame(out, columns=["a", "b", "shared"]).astype("int64")


def pairs(rows: DataFrame, baskets: int, heavy_share: float = HEAVY_SHARE, block: int = BLOCK) -> DataFrame:
    """(field_a, item_a, field_b, item_b, shared, n_a, n_b, lift) of items (basket, field, item) in so many baskets, items of one field not paired."""
    once = durable(rows.where("basket is not null and field is not null and item is not null").select("basket", "field", "item").distinct())
    counts = once.groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))
    # numbers stand for items in the blocks: a hash of 63 bits, whose order is that of neither field nor item
    number = F.xxhash64("field", "item")
    heavy = counts.where(F.col("n") >= max(1.0, heavy_share * baskets)).select(number.alias("item_id"), F.lit(True).alias("heavy"))
    blocks = max(1, -(-baskets // block))
    numbered = once.select(F.xxhash64("basket").alias("basket"), number.alias("item_id"), F.xxhash64("field").alias("field_id"))
    placed = numbered.join(F.broadcast(heavy), "item_id", "left").select(F.pmod(F.hash("basket"), F.lit(blocks)).alias("block"), "basket", "item_id", "field_id", F.coalesce("heavy", F.lit(False)).alias("heavy"))
    partial = placed.groupBy("block").applyInPandas(pair_counts, "a bigint, b bigint, shared bigint")
    summed = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    named = counts.select(number.alias("id"), "field", "item", "n")
    x = summed.join(named.toDF("a", "field_a", "item_a", "n_a"), "a").join(named.toDF("b", "field_b", "item_b", "n_b"), "b")
    swap = F.struct("field_a", "item_a") > F.struct("field_b", "item_b")
    pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
    x = x.select(*(pick(f"{c}_{p}", f"{c}_{q}").alias(f"{c}_{p}") for p, q in (("a", "b"), ("b", "a")) for c in ("field", "item", "n")), "shared")
    return x.withColumn("lift", F.col("shared") * F.lit(baskets) / (F.col("n_a") * F.col("n_b")))


def settled_items(cells: DataFrame) -> DataFrame:
    """(basket, field, item): the folded values of cells that were accepted or repaired."""
    return cells.where(F.col("disposition").isin("accepted", "repaired")).select(F.col("call_id").alias("basket"), "field", folded("value").alias("item")).where("item <> ''")


def all_calls(cells: DataFrame) -> int:
    return cells.agg(F.countDistinct("call_id")).first()[0]


def _enum_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    cells = table(spark, sf_dir, "validated_cells")
    enums = table(spark, sf_dir, "schema_fields").where("type = 'enum'").select("field", F.explode("enum_values").alias("v")).select("field", folded("v").alias("item")).distinct()
    total = all_calls(cells)
    return pairs(settled_items(cells).join(enums, ["field", "item"]), total), total


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of enum values of different fields, with its shared calls and lift."""
    x, _ = _enum_pairs(spark, sf_dir)
    return x.select(F.concat_ws("=", "field_a", "item_a").alias("item_a"), F.concat_ws("=", "field_b", "item_b").alias("item_b"), "shared", "n_a", "n_b", "lift")


def p3_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the settled values of every field, dates, sums and notes included."""
    cells = table(spark, sf_dir, "validated_cells")
    return pairs(settled_items(cells), all_calls(cells)).select("field_a", "item_a", "field_b", "item_b", "shared", "lift")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, total = _enum_pairs(spark, sf_dir)
    cases = x.where((F.col("shared") >= 5) & (F.col("shared") * 10_000 >= 15 * total) & (F.col("shared") * total * 10 >= F.col("n_a") * F.col("n_b") * 22))
    a, b = F.concat_ws("=", "field_a", "item_a"), F.concat_ws("=", "field_b", "item_b")
    return cases.select(F.least(a, b).alias("item_a"), F.greatest(a, b).alias("item_b"))


_ITEMS = r"""
enums as (select field, lower(regexp_replace(unnest(enum_values), '^\s+|\s+$', '', 'g')) v from schema_fields where type = 'enum'
), items as (
  select distinct call_id, c.field, c.field || '=' || e.v item
  from validated_cells c join enums e on e.field = c.field and e.v = lower(regexp_replace(c.value, '^\s+|\s+$', '', 'g'))
  where disposition in ('accepted', 'repaired')
), n as (select item, count(*) n from items group by 1
), t as (select count(distinct call_id) total from validated_cells
), s as (
  select a.item item_a, b.item item_b, count(*) shared
  from items a join items b on a.call_id = b.call_id and a.field <> b.field and a.item < b.item group by 1, 2
)
"""
_PAIRS = f"with {_ITEMS} select item_a, item_b, shared, x.n n_a, y.n n_b, shared * total / (x.n * y.n) lift, total from s join n x on x.item = item_a join n y on y.item = item_b, t"
_FREE = r"""
with items as (
  select distinct call_id, field, lower(regexp_replace(value, '^\s+|\s+$', '', 'g')) item from validated_cells
  where disposition in ('accepted', 'repaired') and lower(regexp_replace(value, '^\s+|\s+$', '', 'g')) <> ''
), n as (select field, item, count(*) n from items group by 1, 2), t as (select count(distinct call_id) total from validated_cells
), s as (
  select a.field field_a, a.item item_a, b.field field_b, b.item item_b, count(*) shared
  from items a join items b on a.call_id = b.call_id and a.field < b.field group by 1, 2, 3, 4
)
select s.*, shared * total / (x.n * y.n) lift from s join n x on x.field = field_a and x.item = item_a join n y on y.field = field_b and y.item = item_b, t
"""
SQL = {
    "p3_found": f"select item_a, item_b from ({_PAIRS}) where shared >= 5 and shared >= 0.0015 * total and lift >= 2.2",
    "p3_pairs": f"select item_a, item_b, shared, n_a, n_b, lift from ({_PAIRS})",
    "p3_all_fields": _FREE,
}
QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs, "p3_all_fields": p3_all_fields}
