"""Every query of the engine, by the id of its operator, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import queries_graph, queries_project, queries_relations

_PARTS = (queries_graph, queries_relations, queries_project)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.Q.items()}


def oracle_sql() -> dict:
    return {k: v for part in _PARTS for k, v in part.S.items()}
