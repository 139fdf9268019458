"""name -> query and name -> SQL twin, filled by the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hubbub.plans.adapters import SHARED_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    """build makes the query from the adapted tables; sql follows the WITH list that adapts them for DuckDB."""
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        text = sql.strip()
        ORACLES[name] = SHARED_SQL + (", " + text[5:] if text.upper().startswith("WITH ") else " " + text)


from hubbub.plans import activity, clusters, content, conversations, graph, language, lexicons, linking, neighbourhood, payloads, quality_checks, records, scoring, sharing, signals, streams, units, verdicts, publishing  # noqa: E402, F401
