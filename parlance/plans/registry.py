"""Queries by name, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Oracles before the views are put in front of them.
OVER_VIEWS: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of :class:`Views`; ``oracle`` is SQL over the same views."""

    def register(function: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Views(spark, sf_dir))

        run.__name__, run.__doc__ = name, function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            OVER_VIEWS[name], ORACLES[name] = oracle, with_views(oracle)
        return function

    return register
