"""Registry of the library's queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphmill.plans import problems, q_graph, q_search, q_sources, q_text

_MODULES = [q_text, q_graph, q_search, q_sources, problems]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q_graph.graph_match_typed(spark, d)


def queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.queries())
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.oracle_sql())
    return out
