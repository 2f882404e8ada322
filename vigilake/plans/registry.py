"""All registered queries of the reference's operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigilake.plans import action_queries, chain_queries, gate_queries, relay_queries, rule_queries, session_queries, text_queries

_GROUPS = (text_queries, rule_queries, action_queries, chain_queries, gate_queries, relay_queries, session_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language and tier."""
    return text_queries.fw_tier_by_lang(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in _GROUPS for name, f in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, sql in group.ORACLES.items()}
