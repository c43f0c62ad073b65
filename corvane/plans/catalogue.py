"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from corvane.plans import catalogue_graph, catalogue_search, catalogue_sql, catalogue_text  # noqa: F401
from corvane.plans.registered import ORACLES, QUERIES, Run


def queries() -> dict[str, Run]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
