"""Queries over the given tables, one per operator, and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, Query]:
    """Every registered query by name."""
    from corpuscle.registry import chunking, context, evaluation, files, retrieval, snapshots

    found: dict[str, Query] = {}
    for module in (files, chunking, snapshots, retrieval, context, evaluation):
        found |= module.QUERIES
    return found


def all_oracles() -> dict[str, str]:
    """The reference SQL of every query that has one."""
    from corpuscle.registry import chunking, context, evaluation, files, retrieval, snapshots

    found: dict[str, str] = {}
    for module in (files, chunking, snapshots, retrieval, context, evaluation):
        found |= module.ORACLES
    return found
