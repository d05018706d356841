"""Operators for language-model data; nothing else in the library imports this part."""

from gleanery.llm import cooccurrence, encoding, lexicon, mixing, packing, percentiles, pii, turns

_MODULES = (lexicon, cooccurrence, pii, percentiles, turns, packing, mixing, encoding)


def queries():
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracle_sql():
    return {k: q for m in _MODULES for k, q in m.SQL.items()}
