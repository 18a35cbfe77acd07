"""All queries outside the llm subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import general, graph, manifest, navigation, paths, projections, provenance, ranking, symbols, text, vectors

_MODULES = (general, text, manifest, navigation, paths, projections, vectors, symbols, navigation, graph, ranking, provenance)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
