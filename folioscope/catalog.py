"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from folioscope.plans import artifacts, history, lists, made, pages, probes, products, resampling, stats, store, streams, study, tables, texts

MODULES = (pages, made, artifacts, products, lists, texts, probes, store, history, stats, resampling, study, tables, streams)


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
