"""Registered queries and the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its oracle."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


from . import bound_queries, edit_queries, figure_queries, history_queries, line_queries, rewrite_queries, scalar_queries, seam_queries, signal_queries, span_queries, text_queries, word_queries  # noqa: E402, F401
