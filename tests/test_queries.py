"""Every registered query against its SQL, where it has one, on the smallest tables; a few without it must run."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as from '{DATA}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Without SQL: run here, tested on small tables elsewhere.
RUN = {"corpus_generate", "discovered_schema", "extract_cells", "pipeline_end_to_end", "stream_rollup"}


@pytest.mark.parametrize("name", sorted((set(entry.oracle_sql()) | RUN) & set(entry.queries())))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if name in entry.oracle_sql():
        r = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in r.description]
        assert sorted(columns) == names
        assert got == Counter(tuple(plain(r[columns.index(n)]) for n in names) for r in r.fetchall())
