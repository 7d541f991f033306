"""All queries of the core, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import collection, extensions, further, grammar_tasks, graph_tasks, graphs, language, pipeline, problems, reasoning, relational, scoring

FAMILIES = [pipeline, relational, graphs, reasoning, language, scoring, collection, further, extensions, problems, graph_tasks, grammar_tasks]
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for family in FAMILIES:
        out.update(family.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for family in FAMILIES:
        out.update(getattr(family, "oracle_sql", dict)())
    return out
