"""The core's queries and their SQL, gathered from the operators."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanery.operators import activation, cells, detect, discovery, evaluation, faults, funnel, grounding, load_profile, mining, sampling, texts, trace
from gleanery.streaming import rollup

from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (load_profile, cells, mining, texts, trace, grounding, funnel, evaluation, sampling, faults, detect, discovery, activation, rollup, pipeline)


def queries() -> dict[str, Query]:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
