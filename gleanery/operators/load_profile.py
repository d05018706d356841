"""Problem 2: column-level quality profile of every load, with a classifier two-sample test between loads.

Three parts make one row per load and field:

* exact base aggregates of value, confidence and disposition over all rows as they are;
* a classifier two-sample test: a logistic regression learns to tell the rows of the load from those of the
  field's other loads. It is fitted on binned columns, so its sufficient statistics are counts per bin, made by one
  partial aggregation over all rows; fitting costs the same for a thousand rows or 10^12. Folds go by a hash of
  call_id; each fold is scored by the model of the other folds (cross-fitting), and the pooled scores give the
  discrimination (area under the curve, 0.5: the loads look alike);
* ablation per column: the area lost without the column and the area reached by the column alone.

The test nominates the columns of a load that changed; for a nominated column the exact figures then decide
on null_rate, confidence_shift and disposition_shift. value_pattern, confidence_range and disposition_label
are no changes between loads but levels, and are read off the exact aggregates.

Nulls: a null load_no or field is a group of its own; null values, confidences and dispositions are bins of their own.
A load with fewer than LEAST rows on either side can't be tested: its auc is null and all its columns count as
nominated. An empty table gives no rows. Columns of other names are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.common import table

LABELS = ("accepted", "repaired", "human_review")
COLUMNS = ("value", "confidence", "disposition")
FOLDS, LEAST, NOMINATED_AUC = 3, 30, 0.515
KEYS = ("load_no", "field")


def typed(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """The cells with fits: whether a value is of its field's type (null for a null value)."""
    types = fields.groupBy("field").agg(F.first("type", True).alias("_type"), F.first("enum_values", True).alias("_enum"))
    fits = (
        F.when(F.col("_type") == "number", F.col("value").rlike(r"\A-?[0-9]+(\.[0-9]+)?\z"))
        .when(F.col("_type") == "date", F.col("value").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.expr("try_cast(value as date)").isNotNull())
        .when(F.col("_type") == "boolean", F.col("value").isin("true", "false"))
        .when(F.col("_type") == "enum", F.coalesce(F.array_contains("_enum", F.col("value")), F.lit(False)))
        .otherwise(F.lit(True))
    )
    # schema_fields has a row per field of the schema; Spark broadcasts it if it is small
    return cells.join(types, "field", "left").withColumn("fits", F.when(F.col("value").isNotNull(), fits)).drop("_enum")


def base_profile(cells: DataFrame) -> DataFrame:
    """Exact aggregates per load and field; the one distinct count is spread by value before it is merged."""
    inside = F.col("confidence").between(0, 1)
    return cells.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_value"),
        F.count_if(~F.col("fits")).alias("n_misfit"),
        F.countDistinct("value").alias("distinct_values"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("confidence").alias("n_confidence"),
        F.count_if(F.col("confidence").isNotNull() & ~inside).alias("n_outside"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.avg(F.when(inside, F.col("confidence"))).alias("mean_confidence"),
        F.count("disposition").alias("n_disposition"),
        F.count_if(~F.col("disposition").isin(*LABELS)).alias("n_label"),
    )


def binned(cells: DataFrame) -> DataFrame:
    """(load_no, field, fold, value_bin, confidence_bin, disposition_bin, n): the statistics the classifiers need, of bounded size per load and field."""
    number = F.expr("try_cast(value as double)")
    value = (
        F.when(F.col("value").isNull(), -1)
        .when(~F.col("fits"), -2)
        .when((F.col("_type") == "number") & number.isNotNull(), F.least(F.lit(7), F.floor(F.log2(1 + F.abs(number)) / 2)))
        .otherwise(F.pmod(F.xxhash64("value"), F.lit(8)))
    )
    c = F.col("confidence")
    confidence = F.when(c.isNull() | F.isnan(c), -1).when(c < 0, -2).when(c > 1, -3).otherwise(F.least(F.lit(9), F.floor(c * 10)))
    d = F.col("disposition")
    disposition = F.when(d.isNull(), -1).when(d == LABELS[0], 0).when(d == LABELS[1], 1).when(d == LABELS[2], 2).otherwise(3 + F.pmod(F.xxhash64(d), F.lit(8)))
    return cells.groupBy(
        *KEYS,
        F.pmod(F.xxhash64("call_id"), F.lit(FOLDS)).cast("int").alias("fold"),
        value.cast("int").alias("value_bin"),
        confidence.cast("int").alias("confidence_bin"),
        disposition.cast("int").alias("disposition_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


def one_hot(codes: np.ndarray) -> np.ndarray:
    return np.hstack([(col[:, None] == np.unique(col)[None, :]).astype(float) for col in codes.T] + [np.ones((len(codes), 1))])


def fit_logistic(x: np.ndarray, n1: np.ndarray, n0: np.ndarray, ridge: float = 1.0, steps: int = 6) -> np.ndarray:
    """Newton's method on grouped counts; both classes carry the same total weight, so the intercept is no news."""
    w1, w0 = n1 / max(n1.sum(), 1), n0 / max(n0.sum(), 1)
    size = min(n1.sum(), n0.sum())
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ ((w1 * (1 - p) - w0 * p) * size) - ridge * b
        h = (x * ((w1 + w0) * size * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-3:
            break
    return b


def area(score: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> float:
    """Area under the curve of grouped scores; ties count half."""
    _, at = np.unique(np.round(score, 9), return_inverse=True)
    p, q = np.bincount(at, n1), np.bincount(at, n0)
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()))


def cross_fitted(codes: np.ndarray, fold: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> float:
    """Mean over the folds of the area that a model of the other folds reaches on the fold."""
    rows, at = np.unique(np.column_stack([codes, fold]), axis=0, return_inverse=True)
    at = at.ravel()
    n1, n0, fold, x = np.bincount(at, n1), np.bincount(at, n0), rows[:, -1], one_hot(rows[:, :-1])
    areas = []
    for k in range(FOLDS):
        held = fold == k
        if n1[held].sum() and n0[held].sum() and n1[~held].sum() and n0[~held].sum():
            areas.append(area(x[held] @ fit_logistic(x[~held], n1[~held], n0[~held]), n1[held], n0[held]))
    return float(np.mean(areas)) if areas else 0.5


def _tested(pdf):
    import pandas as pd

    codes, fold = pdf[[f"{c}_bin" for c in COLUMNS]].to_numpy(), pdf["fold"].to_numpy()
    n1, n0 = pdf["n1"].to_numpy(float), pdf["n0"].to_numpy(float)
    out = {k: pdf[k].iloc[0] for k in KEYS}
    if min(n1.sum(), n0.sum()) < LEAST:
        return pd.DataFrame([out | {"auc": None} | {f"{p}_{c}": None for c in COLUMNS for p in ("lost_without", "auc_of")}])
    full = cross_fitted(codes, fold, n1, n0)
    out["auc"] = full
    for i, c in enumerate(COLUMNS):
        out[f"lost_without_{c}"] = full - cross_fitted(np.delete(codes, i, axis=1), fold, n1, n0)
        out[f"auc_of_{c}"] = cross_fitted(codes[:, [i]], fold, n1, n0)
    return pd.DataFrame([out])


def two_sample(bins: DataFrame) -> DataFrame:
    """auc, and per column what is lost without it and what it reaches alone, for each load and field.

    A group holds the bins of one load and of the rest of its field: some thousand rows at most, however many rows the loads have.
    """
    b = [*("fold",), *(f"{c}_bin" for c in COLUMNS)]
    whole = bins.groupBy("field", *b).agg(F.sum("n").alias("total"))
    loads = bins.select(*KEYS).distinct()
    pairs = loads.alias("l").join(whole.alias("w"), F.expr("l.field <=> w.field")).select("l.load_no", "l.field", *b, "total")
    own = pairs.alias("p").join(bins.alias("o"), F.expr(" and ".join(f"p.{k} <=> o.{k}" for k in [*KEYS, *b])), "left")
    counted = own.select(*(f"p.{k}" for k in [*KEYS, *b]), F.coalesce("o.n", F.lit(0)).alias("n1"), "total").withColumn("n0", F.col("total") - F.col("n1"))
    kind = {f.name: f.dataType.simpleString() for f in bins.schema}
    parts = "".join(f", lost_without_{c} double, auc_of_{c} double" for c in COLUMNS)
    return counted.groupBy(*KEYS).applyInPandas(_tested, f"load_no {kind['load_no']}, field {kind['field']}, auc double{parts}")


def label_shares(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """The largest departure of any label's share from its median over the loads of the field, where it is above 0.23.

    Only a label that somewhere has a share above 0.23 can depart by more, so at most four labels per load are compared.
    """
    counts = cells.where("disposition is not null").groupBy(*KEYS, "disposition").agg(F.count(F.lit(1)).alias("k"))
    s = counts.alias("c").join(sizes.alias("s"), F.expr("c.load_no <=> s.load_no and c.field <=> s.field")).select("c.*", (F.col("k") / F.col("n")).alias("share"))
    big = s.where("share > 0.23").select("field", "disposition").distinct()
    grid = sizes.alias("s").join(big.alias("b"), F.expr("s.field <=> b.field")).select("s.load_no", "s.field", "b.disposition")
    grid = grid.alias("g").join(s.alias("s"), F.expr("g.load_no <=> s.load_no and g.field <=> s.field and g.disposition = s.disposition"), "left")
    grid = grid.select("g.*", F.coalesce("s.share", F.lit(0.0)).alias("share"))
    mid = F.median("share").over(Window.partitionBy("field", "disposition"))
    return grid.withColumn("off", F.abs(F.col("share") - mid)).groupBy(*KEYS).agg(F.max("off").alias("label_off"))


def load_profile(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per load and field: exact figures, discrimination, ablation, nominated columns, issues."""
    cells = typed(cells.select(*KEYS, "call_id", *COLUMNS), fields.select("field", "type", "enum_values"))
    p = base_profile(cells)
    test = two_sample(binned(cells))
    off = label_shares(cells, p.select(*KEYS, "n"))
    same = F.expr("p.load_no <=> x.load_no and p.field <=> x.field")
    p = p.alias("p").join(test.alias("x"), same, "left").select("p.*", *(f"x.{c}" for c in test.columns if c not in KEYS))
    p = p.alias("p").join(off.alias("x"), same, "left").select("p.*", F.coalesce("x.label_off", F.lit(0.0)).alias("label_off"))
    field = Window.partitionBy("field")
    p = p.withColumn("null_share", 1 - F.col("n_value") / F.col("n"))
    p = p.withColumn("null_off", F.abs(F.col("null_share") - F.median("null_share").over(field)))
    p = p.withColumn("confidence_off", F.abs(F.col("mean_confidence") - F.median("mean_confidence").over(field)))
    changed = {c: F.col("auc").isNull() | (F.col(f"auc_of_{c}") > NOMINATED_AUC) for c in COLUMNS}
    p = p.withColumn("nominated", F.filter(F.array(*(F.when(x, F.lit(c)) for c, x in changed.items())), lambda c: c.isNotNull()))
    issues = {
        "null_rate": F.array_contains("nominated", "value") & F.expr("null_off > 0.23"),
        "value_pattern": F.expr("n_misfit * 100 > n_value * 9"),
        "confidence_range": F.expr("n_outside * 100 > n_confidence * 3"),
        "confidence_shift": F.array_contains("nominated", "confidence") & F.expr("confidence_off > 0.15"),
        "disposition_shift": F.array_contains("nominated", "disposition") & F.expr("label_off > 0.23"),
        "disposition_label": F.expr("n_label * 100 > n_disposition * 3"),
    }
    return p.withColumn("issues", F.filter(F.array(*(F.when(x, F.lit(k)) for k, x in issues.items())), lambda c: c.isNotNull()))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_profile(table(spark, sf_dir, "validated_cells"), table(spark, sf_dir, "schema_fields"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_profile(spark, sf_dir).select("load_no", "field", F.explode("issues").alias("issue"))


P2_SQL = r"""
with c as (
  select load_no, v.field, value, confidence, disposition,
    case s.type when 'number' then regexp_full_match(value, '-?[0-9]+(\.[0-9]+)?')
      when 'date' then regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(value as date) is not null
      when 'boolean' then value in ('true', 'false') when 'enum' then list_contains(s.enum_values, value) else true end fits
  from validated_cells v left join schema_fields s on s.field = v.field
), p as (
  select load_no, field, count(*) n, 1 - count(value) / count(*) nulls,
    count(*) filter (value is not null and not fits) / nullif(count(value), 0) misfit,
    count(*) filter (confidence < 0 or confidence > 1) / nullif(count(confidence), 0) outside,
    avg(confidence) filter (confidence between 0 and 1) mean,
    count(*) filter (disposition not in ('accepted', 'repaired', 'human_review')) / nullif(count(disposition), 0) label
  from c group by 1, 2
), m as (select field, median(nulls) nulls, median(mean) mean from p group by 1
), d as (select load_no, field, disposition, count(*) k from c where disposition is not null group by 1, 2, 3
), g as (
  select p.load_no, p.field, l.disposition, coalesce(k, 0) / n share
  from p join (select distinct field, disposition from d) l on l.field = p.field
  left join d on d.load_no = p.load_no and d.field = p.field and d.disposition = l.disposition
), gm as (select field, disposition, median(share) mid from g group by 1, 2)
select p.load_no, p.field, 'null_rate' issue from p join m on m.field = p.field where abs(p.nulls - m.nulls) > 0.23
union all select load_no, field, 'value_pattern' from p where misfit > 0.09
union all select load_no, field, 'confidence_range' from p where outside > 0.03
union all select p.load_no, p.field, 'confidence_shift' from p join m on m.field = p.field where abs(p.mean - m.mean) > 0.15
union all select load_no, field, 'disposition_label' from p where label > 0.03
union all select distinct g.load_no, g.field, 'disposition_shift' from g join gm on gm.field = g.field and gm.disposition = g.disposition where abs(share - mid) > 0.23
"""


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile}
SQL = {"p2_found": P2_SQL}
