"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import audit_queries, change_queries, fact_queries, graph_queries, history_queries, product_queries, retrieval_queries, text_queries

GROUPS = [history_queries, retrieval_queries, change_queries, graph_queries, fact_queries, audit_queries, product_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for g in GROUPS for name, f in g.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.oracle_sql().items()}
