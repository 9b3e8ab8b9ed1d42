"""The queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from panelweave.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
MODULES = ("operators.joins", "operators.windows", "operators.aggregates", "operators.rankings", "operators.scores", "operators.graph", "operators.forecasts", "operators.errors", "operators.risk", "operators.structure", "operators.quality", "functions.scalars", "sources.files", "streaming.events", "operators.fundamentals", "operators.survival", "operators.health", "operators.fund", "operators.macro", "operators.estimation", "operators.fields", "operators.ensembles", "operators.models", "operators.recurrences", "operators.survival_models", "operators.mixtures", "operators.complexity", "operators.dependence", "operators.trees", "operators.imputation", "operators.subsequences", "operators.selection", "functions.surface", "streaming.keyed")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` may name the views of ``plans``."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = with_views(" ".join(sql.split()))
        return f

    return put


def load() -> None:
    for m in MODULES:
        import_module(f"panelweave.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return _QUERIES["flagship_panel"](spark, sf_dir)


def queries() -> dict[str, Query]:
    load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    load()
    return dict(_ORACLES)
