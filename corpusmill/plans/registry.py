"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources.views import duckdb_views

from . import analysis, catalog, corpus, datasets, evaluation, extras, files, roundtrips, sounds, studio, texts

MODULES = (evaluation, corpus, analysis, datasets, extras, catalog, texts, studio, sounds, files, roundtrips)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL over the views; one that starts with a name adds to the WITH clause."""
    found = {}
    for m in MODULES:
        for name, (_, sql) in m.QUERIES.items():
            if sql is not None:
                sql = sql.strip()
                found[name] = duckdb_views() + ("\n" if sql.startswith(("select", "(")) else ",\n") + sql
    return found


def run(task: str, spark: SparkSession, folder: str) -> DataFrame:
    """The query of this name; an unknown name says which there are."""
    known = queries()
    if task not in known:
        raise ValueError(f"no query {task!r}; there are {', '.join(sorted(known))}")
    return known[task](spark, folder)
